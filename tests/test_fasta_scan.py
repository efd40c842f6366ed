"""The scan by lines against the reader of whole records, over splits of a few bytes."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import sequences as sq
from strandline.sources.fasta_scan import open_scan, scan_fasta, write_scan
from strandline.sources.readers import read_fasta

BYTES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def split_at(spark):
    kept, cost = spark.conf.get(BYTES), spark.conf.get("spark.sql.files.openCostInBytes")

    def set_size(n):
        spark.conf.set(BYTES, n)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield set_size
    spark.conf.set(BYTES, kept)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def random_fasta(rng, n, end="\n"):
    lines = []
    for k in range(n):
        lines.append(f">r{k} more words" if rng.random() < 0.5 else f">r{k}")
        left = rng.choice([0, 0, 1, 59, 60, 61, 200])
        while left > 0:
            size = min(left, rng.choice([1, 20, 60, 60]))
            lines.append("".join(rng.choice("ACGTacgtN") for _ in range(size)))
            left -= size
            if rng.random() < 0.05:
                lines.append("")
    return end.join(lines) + (end if rng.random() < 0.5 else "")


def rows_of(table, *columns):
    return sorted(tuple(r) for r in table.select(*columns).collect())


@pytest.mark.parametrize("size, split, end", [(16, 37, "\n"), (7, 64, "\r\n"), (100, 1000, "\n"), (16_384, 1 << 20, "\n")])
def test_the_scan_is_that_of_whole_records(spark, split_at, tmp_path, size, split, end):
    rng = random.Random(size + split)
    for k in range(3):
        (tmp_path / f"{k}.fa").write_text(random_fasta(rng, rng.randrange(1, 12), end).replace(">r", f">f{k}r"), newline="")
    split_at(1 << 20)
    whole = read_fasta(spark, str(tmp_path)).select("name", "sequence")
    lengths = rows_of(whole, "name", F.length("sequence").cast("long"))
    chunks = rows_of(sq.chunk_table(whole, size), "seq", "chunk_no", "chunk")
    split_at(split)
    scan = scan_fasta(spark, str(tmp_path), size=size)
    if split < 100:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert rows_of(scan.index, "name", "length") == lengths
    assert rows_of(scan.chunks, "seq", "chunk_no", "chunk") == chunks
    order = [r.name for r in scan.index.orderBy("seq_ord").collect()]
    assert order == [line[1:].split(" ")[0].strip() for k in range(3) for line in (tmp_path / f"{k}.fa").read_text().split("\n") if line[:1] == ">"]
    assert sorted(r.seq_ord for r in scan.index.collect()) == list(range(len(order)))


def test_names_filters_and_odd_files(spark, split_at, tmp_path):
    split_at(40)
    (tmp_path / "a.fa").write_text("lost\nACGT\n>one x\nAC GT\n\tAC\n>two\n>one\nTTTT\n>\nA")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">three\n" + "ACGTN\n" * 50)
    scan = scan_fasta(spark, str(tmp_path), size=10)
    assert rows_of(scan.index, "name", "seq_ord", "length") == [("", 3, 1), ("one", 0, 6), ("one", 2, 4), ("three", 4, 250), ("two", 1, 0)]
    # Records of one name stay apart by their place.
    assert rows_of(scan.chunks.where("seq = 'one'"), "seq_ord", "chunk_no", "chunk") == [(0, 0, "ACGTAC"), (2, 0, "TTTT")]
    assert scan.chunks.where("seq = 'three'").count() == 25
    some = scan_fasta(spark, str(tmp_path), include=["one", "two", "three"], exclude=["one"], size=10)
    assert rows_of(some.index, "name", "seq_ord") == [("three", 4), ("two", 1)] and {r.seq for r in some.chunks.collect()} == {"three"}
    assert rows_of(scan_fasta(spark, str(tmp_path / "a.fa"), split_name=False).index, "name")[1] == ("one",)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.fa").write_text("")
    empty = scan_fasta(spark, str(tmp_path / "none"))
    assert empty.index.count() == empty.chunks.count() == 0


def test_a_written_scan_is_an_index_to_fetch_from(spark, split_at, tmp_path):
    split_at(1000)
    rng = random.Random(1)
    letters = "".join(rng.choice("ACGT") for _ in range(20_000))
    (tmp_path / "long.fa").write_text(">long\n" + "\n".join(letters[k : k + 60] for k in range(0, len(letters), 60)))
    write_scan(scan_fasta(spark, str(tmp_path / "long.fa"), size=256), str(tmp_path / "index"))
    scan = open_scan(spark, str(tmp_path / "index"))
    ranges = spark.createDataFrame([("a", "long", 0, 100, 5_000), ("b", "long", 0, 0, 20_000), ("c", "long", 0, 19_999, 20_000)], "fetch_id string, seq string, part int, start long, end long")
    got = {r.fetch_id: r.sequence for r in sq.fetch_indexed(scan.chunks, ranges, 256).collect()}
    assert got == {"a": letters[100:5_000], "b": letters, "c": letters[-1:]}
    assert scan.index.first().length == 20_000
    # No row holds the contig, and many tasks read it.
    assert scan.chunks.agg(F.max(F.length("chunk"))).first()[0] == 258
    assert spark.read.text(str(tmp_path / "long.fa")).rdd.getNumPartitions() >= 20
