"""Genes within chunks and over borders against those of all regions."""

import random

from pyspark.sql import functions as F

from strandline.operators import labels as lb
from strandline.operators import repair
from strandline.plans.annotate import _numbered
from strandline.tables import Workspace

SIDES = "seq string, strand string, chunk_no long, states array<int>"


def _chunks(spark, rng: random.Random, size: int):
    rows, lengths = [], []
    for k, length in enumerate([1, 7, 8, 9, 40, 200, 333]):
        seq, n = f"s{k}", -(-length // size)
        lengths.append((seq, length))
        for strand in "+-":
            states = []
            while len(states) < n * size:
                states += [rng.choice([0, 0, 1, 4, 14])] * rng.choice([1, 1, 2, 3, 20])
            rows += [(seq, strand, c, states[c * size : (c + 1) * size]) for c in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SIDES), spark.createDataFrame(lengths, "seq string, length long")


def test_genes_of_chunks_are_those_of_regions(spark):
    rng, space = random.Random(4), Workspace(spark, "test")
    for size in (8, 32):
        chunks, lengths = _chunks(spark, rng, size)
        want = lb.merged_strands(lb.region_transcripts(lb.chunk_regions(chunks, size, lengths)), 5)
        sides = space.keep(lb.paired_strands(chunks, size, lengths))
        over = space.keep(lb.region_transcripts(lb.border_regions(sides, size)))
        assert 0 < over.count() < want.count()
        columns = ["seq", "strand", "tx", "cds"]
        got = _numbered([(sides, over, size)], 5, space).orderBy("tx").select(*columns).collect()
        assert got == want.orderBy("tx").select(*columns).collect() and got[0].tx == 5
        # Two parts of different sequences are numbered together.
        parts = [(sides.where(F.col("seq").isin("s0", "s6") == first), over.where(F.col("seq").isin("s0", "s6") == first), size) for first in (True, False)]
        assert _numbered(parts, 5, space).orderBy("tx").select(*columns).collect() == got


def test_long_chunks_are_few_region_rows(spark):
    states = [0, 4, 1, 4] * 500
    chunks = spark.createDataFrame([("a", s, c, states) for s in "+-" for c in range(4)], SIDES)
    sides = lb.paired_strands(chunks, 2000, spark.createDataFrame([("a", 8000)], "seq string, length long"))
    assert {r.n for r in sides.collect()} == {998} and lb.border_regions(sides, 2000).count() < 50
    assert lb.chunk_regions(chunks, 2000).count() == 16_000


def test_second_predictions_that_agree_do_not_travel(spark):
    chunks = spark.createDataFrame([("a", "+", c, [4] * 8) for c in range(9)], SIDES)
    again = spark.createDataFrame([("a", "+", b, 2, [4] * 8 if b != 3 else [4] * 7 + [5]) for b in range(8)], "seq string, strand string, boundary long, asked int, states array<int>")
    assert [r.boundary for r in repair._differing(chunks, again, 8, None).collect()] == [3]
    got = repair.repaired(chunks, again, 8).orderBy("chunk_no").collect()
    whole = repair.border_merges(chunks, again, 8)
    want = repair.cleared(repair._with_halves(chunks, whole, 8), whole.where("NOT fits"), 8).orderBy("chunk_no").collect()
    assert got == want
