"""Class codes without all pairs against all pairs."""

import random

from pyspark.sql import functions as F

from strandline.operators import comparison
from strandline.operators.comparison import CODES, NEAR_BY
from strandline.operators.transcripts import coding_length, end, introns, start

SCHEMA = "seq string, strand string, tx long, gene long, cds array<struct<start:long,end:long>>"


def _transcripts(rng: random.Random, n: int, first: int, wide: int) -> list:
    out = []
    for k in range(n):
        at, cds = rng.randrange(wide), []
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            size = rng.choice([2, 10, 20, 21, 40, 90])
            cds.append((at, at + size))
            at += size + rng.choice([1, 5, 20, 20, 60, 300])
        out.append((rng.choice("ab"), rng.choice("+-"), first + k, (first + k) // 3, cds))
    return out


def _by_all_pairs(query, reference, tolerance: int) -> dict:
    cut = [introns(F.col("cds")).alias("gaps"), start(F.col("cds")).alias("low"), end(F.col("cds")).alias("high")]
    q, r = (x.select("seq", "strand", "tx", "gene", "cds", *cut) for x in (query, reference))
    r = r.select("seq", F.col("tx").alias("ref_id"), F.col("gene").alias("ref_gene"), *(F.col(c).alias(f"ref_{c}") for c in ("strand", "cds", "gaps", "low", "high")))
    pairs = q.join(r, "seq").where((F.col("low") < F.col("ref_high") + NEAR_BY) & (F.col("ref_low") - NEAR_BY < F.col("high")))
    common = F.least("high", "ref_high") - F.greatest("low", "ref_low")
    best = F.min(F.struct(comparison._pair_codes(pairs, tolerance), -common, "ref_id", "ref_gene", coding_length(F.col("ref_cds")))).alias("b")
    return {r["tx"]: (CODES[r["b"][0]], *r["b"][2:]) for r in pairs.groupBy("tx").agg(best).collect() if CODES[r["b"][0]] != "u"}


def _same_as_all_pairs(spark, seed: int, n: int, wide: int) -> set:
    rng = random.Random(seed)
    refs, few = _transcripts(rng, n, 10_000, wide), _transcripts(rng, n // 2, 0, wide)
    for k in range(n // 2):  # parts and changed copies of references
        seq, strand, _, _, cds = rng.choice(refs)
        begin = rng.randrange(len(cds))
        part = [list(c) for c in cds[begin : rng.randrange(begin, len(cds)) + 1]]
        part[-1][1] += rng.choice([0, 0, 2, 3])
        if len(part) > 1 and rng.random() < 0.4:
            part[:2] = [[part[0][0], part[1][1]]]  # the first intron is within a block
        if rng.random() < 0.3:
            part.append([part[-1][1] + 30, part[-1][1] + 60])
        few.append((seq, rng.choice([strand, strand, "-"]), 5_000 + k, k, [tuple(c) for c in part]))
    query, reference = (spark.createDataFrame(rows, SCHEMA) for rows in (few, refs))
    want = _by_all_pairs(query, reference, 2)
    got = {r.qry_id: (r.class_code, r.ref_id, r.ref_gene_id, r.ref_match_len) for r in comparison.class_codes(query, reference, tolerance=2).collect()}
    assert set(got) == {x[2] for x in few}
    assert {t: x for t, x in got.items() if x[0] != "u"} == want
    return {x[0] for x in got.values()}


def test_codes_are_those_of_all_pairs(spark):
    seen = _same_as_all_pairs(spark, 1, 200, 1_500) | _same_as_all_pairs(spark, 2, 200, 60_000) | _same_as_all_pairs(spark, 3, 60, 300_000)
    assert seen == set(CODES) - {"r"}


def test_deep_references_need_few_pairs(spark):
    """3,000 queries lie over each of 3,000 references, nine million pairs; few of them are looked at whole."""
    cds = "array(struct(id % 50 AS start, id % 50 + 100 + id AS end), struct(4000 + id % 7 AS start, 8000 + id AS end))"
    query = spark.range(3_000).selectExpr("'a' AS seq", "'+' AS strand", "id AS tx", "id AS gene", f"{cds} AS cds")
    reference = spark.range(3_000).selectExpr("'a' AS seq", "'+' AS strand", "id AS tx", "id AS gene", "array(struct(20 + id AS start, 40 + id AS end)) AS cds")
    seen = []
    whole = comparison._pair_codes
    comparison._pair_codes = lambda pairs, tolerance: seen.append(pairs.count()) or whole(pairs, tolerance)
    try:
        got = comparison.class_codes(query, reference).groupBy("class_code").count().collect()
    finally:
        comparison._pair_codes = whole
    assert sum(r["count"] for r in got) == 3_000 and sum(seen) < 100_000
