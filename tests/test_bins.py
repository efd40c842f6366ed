"""The bin index: bins by hand, lookups against plain comparisons, and the row groups that a lookup reads."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.bins import bin_of, overlapping_binned, stretches, write_binned


def plain_bin(low, high, shift, depth):
    last, offset = max(high - 1, low), [(8**k - 1) // 7 for k in range(depth + 1)]
    for level in range(depth, 0, -1):
        s = shift + 3 * (depth - level)
        if low >> s == last >> s and 0 <= low >> s < 8**level:
            return offset[level] + (low >> s)
    return 0


def test_bins_by_hand(spark):
    # Bins of the usual scheme (16,384 positions, five levels).
    cases = [(0, 1, 4681), (0, 16_384, 4681), (0, 16_385, 585), (16_384, 20_000, 4682), (131_071, 131_073, 73), (2**29 - 1, 2**29, 37448), (2**29, 2**29 + 5, 0), (0, 2**29, 0), (-5, 3, 0), (7, 7, 4681)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "low long, high long").select("low", "high", bin_of(F.col("low"), F.col("high")).alias("bin"))
    assert {tuple(r) for r in rows.collect()} == set(cases)
    assert stretches(0, 16_384) == [(0, 0), (1, 1), (9, 9), (73, 73), (585, 585), (4681, 4681)]
    assert stretches(5, 5) == stretches(-9, 0) == [(0, 0)] == stretches(2**40, 2**40 + 1)


@pytest.mark.parametrize("shift, depth", [(14, 5), (4, 3)])
def test_each_overlapping_row_lies_in_the_stretches(shift, depth):
    rng = random.Random(shift)
    top = 1 << (shift + 3 * depth)
    for _ in range(5000):
        a, c = (rng.randrange(-top // 8, top + top // 4) for _ in range(2))
        b, d = a + rng.choice([1, 3, 20, top // 9, top * 2]), c + rng.choice([1, 7, 900, top // 3])
        if a < d and c < b:
            number = plain_bin(a, b, shift, depth)
            assert any(x <= number <= y for x, y in stretches(c, d, shift, depth))


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(F.concat(F.lit("chr"), F.col("id") % 4).alias("seq"), F.col("id").alias("tx"), (F.col("id") * 1000 + F.col("id") % 7).alias("tx_start"))
    rows = rows.withColumn("tx_end", F.col("tx_start") + F.when(F.col("tx") % 5000 == 0, 5_000_000).otherwise(500))
    rows = rows.withColumn("more", F.sha2(F.col("tx").cast("string"), 256))
    path = f"file://{tmp_path}/binned"
    write_binned(rows, path, row_group=1 << 18)
    table = spark.read.parquet(path)
    low, high = 100_000_000, 100_020_000
    found = overlapping_binned(table, "chr2", low, high)
    want = rows.where((F.col("seq") == "chr2") & (F.col("tx_start") < high) & (F.col("tx_end") > low))
    assert sorted(r.tx for r in found.collect()) == sorted(r.tx for r in want.collect())
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    text = plan.toString()
    assert "PushedFilters: [" in text and "Or(Or(Or(EqualT" in text
    scan = plan
    while "FileSourceScanExec" not in scan.getClass().getName():
        scan = scan.children().head() if scan.children().size() else scan.inputPlan()
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read < n // 10
