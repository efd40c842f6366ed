"""Block gzip: written in parts, read by blocks, and held against the gzip library and the lookups in chunks."""

import glob
import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandline.operators import sequences as sq
from strandline.sources import block_gzip as bg
from strandline.sources.writers import write_fasta

ROWS, RANGES = "name string, seq_ord long, sequence string", "fetch_id long, seq string, part long, start long, end long"


def parts(path):
    return [open(p, "rb").read() for p in sorted(glob.glob(f"{path}/text/*.fa.gz"))]


def letters(rng, n):
    return "".join(rng.choices("ACGTacgtN", k=n))


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = {"a": letters(rng, 300_000), "empty": "", "b": letters(rng, 16_000), "c": letters(rng, 79), "d": letters(rng, 80), "é": letters(rng, 81), "z": letters(rng, 700_001)}
    target = f"file://{tmp_path_factory.mktemp('blocks')}/genome"
    rows = spark.createDataFrame([(n, k, s) for k, (n, s) in enumerate(texts.items())], ROWS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    bg.compress_sequences(rows, target)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return texts, rows, target


def test_parts_in_order_are_the_text(written):
    texts, _, target = written
    found = parts(target[7:])
    assert len(found) > 1  # the long record goes over parts
    text = "".join(f">{n}\n" + "".join(s[k : k + 80] + "\n" for k in range(0, len(s), 80)) for n, s in texts.items())
    assert gzip.decompress(b"".join(found)).decode() == text
    assert "".join(gzip.decompress(p).decode() for p in found) == text


def test_blocks_tell_their_sizes(spark, written):
    """A reader that hops by the size in each header meets the table's blocks, and an empty one at the end of a part."""
    _, _, target = written
    known = {(r.file, r.at): r for r in spark.read.parquet(f"{target}/blocks").collect()}
    for path in glob.glob(f"{target[7:]}/text/*.fa.gz"):
        data, at, n = open(path, "rb").read(), 0, None
        while at < len(data):
            size = struct.unpack_from("<H", data, at + 16)[0] + 1
            n = len(gzip.decompress(data[at : at + size]))
            assert n == 0 or (known[(path.rsplit("/")[-1], at)].size, known[(path.rsplit("/")[-1], at)].n) == (size, n)
            at += size
        assert n == 0
    assert len(bg.gzip_block(random.Random(1).randbytes(bg.BLOCK))) <= 65_536 and gzip.decompress(bg.gzip_block(b"")) == b""


def test_fetch_equals_that_from_chunks(spark, written):
    texts, rows, target = written
    rng = random.Random(5)
    asked = [(0, "empty", 0, 0, 0), (1, "a", 0, 7, 7), (2, "z", 0, 0, 700_001), (3, "missing", 0, 0, 4)]
    for k in range(4, 60):
        name = rng.choice(["a", "b", "c", "d", "é", "z"])
        for part in range(rng.choice([1, 1, 3])):
            low = rng.randrange(len(texts[name]))
            asked.append((k, name, part, low, min(len(texts[name]), low + rng.choice([1, 79, 80, 81, 5_000, 200_000]))))
    ranges = spark.createDataFrame(asked, RANGES)
    got = sorted(map(tuple, bg.fetch_blocks(spark, target, ranges).collect()))
    assert got == sorted(map(tuple, sq.fetch(rows, ranges).collect())) and len(got) == 59
    with pytest.raises(Exception, match="outside"):
        bg.fetch_blocks(spark, target, spark.createDataFrame([(1, "c", 0, 0, 80)], RANGES)).collect()
    assert bg.fetch_blocks(spark, target, ranges.limit(0)).count() == 0


def test_a_range_touches_few_blocks(spark, written):
    """A thousand letters of a file of blocks are two blocks at most; no other one is read."""
    _, _, target = written
    ranges = spark.createDataFrame([("z", k * 9_973, k * 9_973 + 1_000) for k in range(70)], "seq string, start long, end long")
    n = bg.blocks_of_ranges(spark, target, ranges).groupBy("start").agg(F.count("*").alias("n"), F.sum("_b.size").alias("size")).agg(F.max("n"), F.max("size"), F.count("*")).first()
    assert n[0] <= 2 and n[1] <= 2 * 65_536 and n[2] == 70


def test_chunks_equal_those_of_the_sequences(spark, written):
    _, rows, target = written
    for size in (16_000, 700):
        assert sorted(map(tuple, bg.block_chunks(spark, target, size).collect())) == sorted(map(tuple, sq.chunk_table(rows, size).collect()))


def test_files_are_compressed_and_targets_refused(spark, tmp_path):
    rng = random.Random(9)
    texts = [letters(rng, n) for n in (50_000, 0, 1_000)]
    rows = spark.createDataFrame([("one", 0, texts[0]), ("two", 1, texts[1]), ("one", 2, texts[2])], ROWS)
    write_fasta(rows, f"file://{tmp_path}/plain.fa", width=61)
    bg.compress_fasta(spark, f"file://{tmp_path}/plain.fa", f"file://{tmp_path}/packed", width=50)
    text = gzip.decompress(b"".join(parts(f"{tmp_path}/packed"))).decode()
    assert text == "".join(f">{n}\n" + "".join(s[k : k + 50] + "\n" for k in range(0, len(s), 50)) for n, s in zip(("one", "two", "one"), texts))
    assert {tuple(r) for r in bg.block_lengths(spark, f"file://{tmp_path}/packed").collect()} == {("one", 50_000), ("two", 0)}
    # Parts that no table names go, and none is left by a task that failed.
    with pytest.raises(FileExistsError):
        bg.compress_sequences(rows, f"file://{tmp_path}/packed")
    with pytest.raises(ValueError, match="whole lines"):
        bg.write_block_fasta(None, f"file://{tmp_path}/other", 80, 1_000)
    bg.compress_sequences(rows.limit(0), f"file://{tmp_path}/none")
    assert bg.block_lengths(spark, f"file://{tmp_path}/none").count() == 0
