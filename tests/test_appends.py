"""Appends with one header and running ids, numbering over a stream, and repeated positions."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals
from strandline.operators.transcripts import numbered
from strandline.plans.annotate import annotate_genome
from strandline.plans.convert import convert, load_annotation, write_annotation
from strandline.sources import appends
from strandline.sources.appends import Commit, append_text, last_commit
from strandline.streaming.classify import numbered_stream

TX = "seq string, strand string, tx long, gene long, cds array<struct<start:long,end:long>>"
FIRST = [("a", "+", 1, 1, [(0, 9), (20, 29)]), ("a", "+", 2, 1, [(0, 9)]), ("b", "-", 3, 3, [(5, 11)]), ("b", "-", 4, 4, [])]
SECOND = [("a", "+", 1, 1, [(50, 59)]), ("c", "+", 2, 2, [(1, 4)])]


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_a_second_write_has_no_second_header_and_goes_on_with_ids(spark, tmp_path):
    path = f"file://{tmp_path}/out.gff3"
    first, second = (spark.createDataFrame(rows, TX) for rows in (FIRST, SECOND))
    assert convert(first, path).next_gene_id == 3  # the gene without blocks is not written
    with pytest.raises(ValueError):
        convert(second, path)
    assert convert(second, path, append=True) == Commit(2, 5, True)
    convert(second, path, append=True, first_gene_id=50)
    found = lines(spark, path)
    assert [x for x in found if x.startswith("#")] == ["##gff-version 3"]
    ids = [x.split("ID=")[1].split(";")[0] for x in found if "\tgene\t" in x]
    assert sorted(ids) == sorted(["g1", "g2", "g3", "g4", "g50", "g51"])
    assert last_commit(spark, path) == Commit(3, 52, True) and last_commit(spark, path, before=3).next_gene_id == 5
    assert load_annotation(spark, path).count() == 3 + 2 + 2


def test_a_target_from_elsewhere_and_gzip(spark, tmp_path):
    (tmp_path / "old.gff3").mkdir()
    (tmp_path / "old.gff3" / "part-0.txt").write_text("##gff-version 3\n")
    convert(spark.createDataFrame(SECOND, TX), f"file://{tmp_path}/old.gff3", append=True)
    assert sum(x.startswith("#") for x in lines(spark, f"file://{tmp_path}/old.gff3")) == 1
    for _ in range(2):
        write_annotation(spark.createDataFrame(SECOND, TX), f"file://{tmp_path}/new.gtf.gz", append=True)
    assert {r.gene_name for r in load_annotation(spark, f"file://{tmp_path}/new.gtf.gz").collect()} == {"g1", "g2", "g3", "g4"}


def test_a_failed_append_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    append_text(spark.createDataFrame([("one",)], "line string"), path)
    bad = spark.range(3).select(F.when(F.col("id") < 2, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("broken")).cast("string")).alias("line"))
    with pytest.raises(Exception, match="broken"):
        append_text(bad, path)

    def refuse(*args):
        raise OSError("no commit")

    with monkeypatch.context() as m:
        m.setattr(appends, "commit", refuse)
        with pytest.raises(OSError):
            append_text(spark.createDataFrame([("two",)], "line string"), path)
    assert lines(spark, path) == ["one"] and last_commit(spark, path).number == 1
    # What a writer that died left behind goes with the next append.
    (tmp_path / "out" / "part-a000000002-00000.txt").write_text("lost\n")
    append_text(spark.createDataFrame([("three",)], "line string"), path)
    assert sorted(lines(spark, path)) == ["one", "three"]


def test_genomes_go_on_with_ids(spark, tmp_path):
    genome = spark.createDataFrame([("x", 0, "A" * 10 + "C" * 6 + "A" * 4)], "name string, seq_ord long, sequence string")

    def predict(chunks):
        state = F.transform(F.filter(F.split("chunk", ""), lambda c: c != ""), lambda c: F.when(c == "C", 4).otherwise(0))
        return chunks.select(F.col("name").alias("seq"), F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), "chunk_no", state.alias("states"))

    path = f"file://{tmp_path}/genome.gff3"
    for _ in range(2):
        annotate_genome(genome, predict, path, 20, min_sequence_size=1, append=True)
    found = lines(spark, path)
    assert sum(x.startswith("#") for x in found) == 1
    assert sorted(x.split("ID=")[1].split(";")[0] for x in found if "\tgene\t" in x) == ["g1", "g2", "g3", "g4"]


def test_gene_ids_run_on_over_batches(spark, tmp_path):
    schema = "seq string, strand string, tx long, gene long, cds array<struct<start:long,end:long>>"
    parts = [FIRST[:3], [], SECOND[1:] + [("d", "-", 9, 9, [(3, 6)])]]
    target, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"

    def step():
        numbered_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), lambda rows: rows, target, state).awaitTermination()

    (tmp_path / "in").mkdir()
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        step()
    got = {(r.seq, r.tx): r.gene_id for r in spark.read.parquet(target).collect()}
    want = {(r.seq, r.tx): r.gene_id for r in numbered(spark.createDataFrame(sum(parts, []), schema)).collect()}
    assert got == want
    # A batch that runs again: its checkpoint is lost after it was written.
    last = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))[-1]
    last.unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    step()
    assert {(r.seq, r.tx): r.gene_id for r in spark.read.parquet(target).collect()} == want


def test_repeated_positions_stay(spark):
    transcripts = spark.createDataFrame(FIRST, TX)
    rows = [(7, "a", 3), (7, "a", 3), (7, "a", 12), (8, "a", 3), (None, "b", 6), (9, None, 6), (9, "a", None), (1, "zz", 1)]
    got = intervals.classify_positions(spark.createDataFrame(rows, "pos_id long, seq string, pos long"), transcripts).collect()
    label = {("a", 3): ("cds", "intergenic"), ("a", 12): ("intron", "intergenic"), ("b", 6): ("intergenic", "cds")}
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*r, *label.get(r[1:], ("intergenic", "intergenic")))) for r in rows)


def test_a_range_of_a_whole_chromosome_is_few_pieces(spark):
    n = spark.range(1).select(F.size(intervals.aligned_pieces(F.lit(1).cast("long"), F.lit(248_956_422).cast("long"), intervals.RANGE_TOP))).first()[0]
    assert n < 100
    transcripts = spark.createDataFrame([("a", "+", 1, 1, [(10**6, 10**6 + 9), (2 * 10**8, 2 * 10**8 + 30)])], TX)
    ranges = spark.createDataFrame([("whole", "a", 0, 248_956_422), ("one", "a", 10**6, 10**6 + 1), ("none", "a", 5, 5), ("broken", "a", 0, 10**12)], "range_id string, seq string, range_start long, range_end long")
    got = {(r.range_id, r.seg_start, r.seg_end, r.label) for r in intervals.classify_ranges(ranges, transcripts).where("strand = '+'").collect()}
    inner = [(10**6, 10**6 + 9, "cds"), (10**6 + 9, 2 * 10**8, "intron"), (2 * 10**8, 2 * 10**8 + 30, "cds")]
    assert got == {("one", 10**6, 10**6 + 1, "cds")} | {(n, *x) for n, end in (("whole", 248_956_422), ("broken", 10**12)) for x in [(0, 10**6, "intergenic"), *inner, (2 * 10**8 + 30, end, "intergenic")]}
