import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import checks, comparison, histograms, intervals, setops
from strandline.operators import transcripts as tr

SCHEMA = "seq string, seq_ord long, gene_ord long, tx long, gene long, strand string, cds array<struct<start:bigint,end:bigint>>"


def annotation(spark, rows):
    """rows: (gene, strand, blocks) on chr1."""
    return spark.createDataFrame([("chr1", 0, k, k, g, s, b) for k, (g, s, b) in enumerate(rows)], SCHEMA)


SAMPLE = [(0, "+", [(10, 20), (30, 40)]), (0, "+", [(10, 25), (30, 40)]), (1, "-", [(100, 130)])]


def points(spark, places):
    return spark.createDataFrame([(k, "chr1", p) for k, p in enumerate(places)], "pos_id long, seq string, pos long")


def labels_at(spark, rows, places):
    got = intervals.classify_positions(points(spark, places), annotation(spark, rows), width=16).orderBy("pos_id").collect()
    return [(r.fwd, r.rev) for r in got]


def test_labels_of_positions(spark):
    assert [f for f, _ in labels_at(spark, SAMPLE[:1], [9, 15, 25, 40])] == ["intergenic", "cds", "intron", "intergenic"]
    assert [f for f, _ in labels_at(spark, SAMPLE[:2], [22, 27, 50])] == ["cds", "intron", "intergenic"]
    assert labels_at(spark, SAMPLE, [110, 5, 5]) == [("intergenic", "cds"), ("intergenic", "intergenic"), ("intergenic", "intergenic")]


def test_the_gene_that_starts_first_decides(spark):
    rows = [(0, "+", [(10, 20), (60, 70)]), (1, "+", [(30, 40)]), (2, "+", [(10, 15), (30, 90)])]
    assert [f for f, _ in labels_at(spark, rows, [35, 65, 80])] == ["intron", "cds", "cds"]


def brute_label(rows, strand, pos):
    for gene in sorted({g for g, s, _ in rows if s == strand}, key=lambda g: (min(b[0][0] for h, s, b in rows if h == g and s == strand), g)):
        inside = [b for g, s, b in rows if g == gene and s == strand and b[0][0] <= pos < b[-1][1]]
        if inside:
            return "cds" if any(x <= pos < y for b in inside for x, y in b) else "intron"
    return "intergenic"


def random_rows(rng, n):
    rows = []
    for k in range(n):
        at, blocks = rng.randrange(300), []
        for _ in range(rng.randrange(1, 4)):
            end = at + rng.randrange(1, 20)
            blocks.append((at, end))
            at = end + rng.randrange(1, 30)
        rows.append((2 * (k // 2) + (k % 3 == 0), "+-"[(2 * (k // 2) + (k % 3 == 0)) % 2], blocks))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_and_segments_match_brute_force(spark, seed):
    rows = random_rows(random.Random(seed), 30)
    places = list(range(0, 420, 3))
    assert labels_at(spark, rows, places) == [(brute_label(rows, "+", p), brute_label(rows, "-", p)) for p in places]
    asked = spark.createDataFrame([(1, "chr1", 20, 333)], "range_id long, seq string, range_start long, range_end long")
    got = intervals.classify_ranges(asked, annotation(spark, rows), width=16).collect()
    for strand in "+-":
        pieces = sorted((r.seg_start, r.seg_end, r.label) for r in got if r.strand == strand)
        assert pieces[0][0] == 20 and pieces[-1][1] == 333 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        edges = {x for _, s, b in rows if s == strand for block in b for x in block if 20 < x < 333}
        assert {p[0] for p in pieces[1:]} == edges
        assert all(label == brute_label(rows, strand, a) for a, _, label in pieces)


def test_segments(spark):
    asked = spark.createDataFrame([(1, "chr1", 0, 45), (2, "chr1", 7, 7)], "range_id long, seq string, range_start long, range_end long")
    got = intervals.labelled_map(intervals.classify_ranges(asked, annotation(spark, SAMPLE[:1]))).where("strand = '+'").collect()
    assert len(got) == 1
    assert {k: [tuple(x) for x in v] for k, v in got[0].segments.items()} == {"intergenic": [(0, 10), (40, 45)], "cds": [(10, 20), (30, 40)], "intron": [(20, 30)]}


def test_overlaps_are_counted_once(spark):
    rng = random.Random(3)
    a = [(k, s, s + rng.randrange(0, 60)) for k, s in enumerate(rng.randrange(200) for _ in range(40))]
    b = [(k, s, s + rng.randrange(0, 60)) for k, s in enumerate(rng.randrange(200) for _ in range(40))]
    left = spark.createDataFrame(a, "i long, a long, b long").withColumn("seq", F.lit("x"))
    right = spark.createDataFrame(b, "j long, c long, d long").withColumn("seq", F.lit("x"))
    got = sorted((r.i, r.j) for r in intervals.interval_overlap_join(left, right, ("a", "b"), ("c", "d"), width=8).collect())
    assert got == sorted((i, j) for i, s, e in a for j, t, f in b if s < e and t < f and s < f and t < e)


def test_numbering_and_names(spark):
    rows = annotation(spark, [(5, "+", [(50, 60)]), (3, "+", []), (7, "-", [(1, 9)]), (5, "+", [(55, 60)])])
    got = tr.named(tr.numbered(rows, 10)).orderBy("gene_id", "transcript_id").collect()
    assert [(r.gene, r.gene_id, r.transcript_id, r.tx_name) for r in got] == [(7, 10, 1, "g10_t1"), (5, 11, 1, "g11_t1"), (5, 11, 2, "g11_t2")]
    assert tr.longest(rows.where("gene = 5")).first().tx == 0
    explicit = rows.withColumn("gene_name", F.lit("mine"))
    assert {r.gene_name for r in tr.named(tr.numbered(explicit), "G{gene_id}").collect()} == {"mine"}
    both = tr.appended(rows, rows)
    assert both.agg(F.max("gene_ord")).first()[0] == 7
    assert tr.of_sequence(rows, 0).count() == 4 and tr.of_sequence(rows, "chr2").count() == 0


def test_frames_follow_the_strand(spark):
    rows = annotation(spark, [(0, "+", [(0, 4), (10, 15), (20, 22)]), (1, "-", [(0, 4), (10, 15), (20, 22)])])
    got = {(r.strand, r.cds_start): r.frame for r in tr.frames(tr.exploded(rows)).collect()}
    assert got == {("+", 0): 0, ("+", 10): 2, ("+", 20): 0, ("-", 20): 0, ("-", 10): 1, ("-", 0): 2}


def test_set_operations(spark):
    a = annotation(spark, [(0, "+", [(1, 5)]), (1, "+", [(1, 5)]), (2, "-", [(1, 5)])])
    b = annotation(spark, [(0, "+", [(1, 5)]), (1, "+", [(7, 9)])])
    assert sorted(r.tx for r in setops.intersection(a, b).collect()) == [0, 1]
    assert [r.tx for r in setops.difference(a, b).collect()] == [2]
    assert sorted((r.tx, r.strand, r.cds[0].start) for r in setops.union(a, b).collect()) == [(0, "+", 1), (1, "+", 7), (2, "-", 1)]
    assert [r.tx for r in setops.without(a, a.where("tx < 2")).collect()] == [2]
    assert setops.distinct_structures(a).count() == 2
    assert sorted(tuple(r) for r in setops.equal_genes(a, b).collect()) == [(0, 0), (1, 0)]


def genome(spark, text):
    return spark.createDataFrame([("chr1", 0, text)], "name string, seq_ord long, sequence string")


def test_checks(spark):
    #        0         1         2
    text = "ATGAAAGTccAGAAATAAcTTATGATAG"
    good = [(0, "+", [(0, 6), (12, 18)])]
    assert checks.boundary_faults(annotation(spark, good), genome(spark, text)).collect() == []
    faults = checks.boundary_faults(annotation(spark, [(0, "+", [(1, 6), (12, 18)]), (1, "+", [(0, 6), (12, 17)]), (2, "+", [(0, 5), (11, 18)])]), genome(spark, text)).orderBy("tx").collect()
    assert [(r.fault, r.bad_intron_begins, r.bad_intron_ends) for r in faults] == [("start", 0, 0), ("stop", 0, 0), ("intron", 1, 1)]
    stops = [(0, "+", [(21, 28)]), (1, "+", [(20, 28)]), (2, "+", [(0, 6)])]
    found = checks.inframe_stops(annotation(spark, [(0, "+", [(15, 27)]), *stops]), genome(spark, text)).collect()
    assert [r.tx for r in found] == [0]
    assert [r.tx for r in checks.coding_repeats(annotation(spark, [(0, "+", [(0, 9)]), (1, "+", [(0, 6)])]), genome(spark, text)).collect()] == [0]
    assert [r.tx for r in checks.out_of_bounds(annotation(spark, [(0, "+", [(0, 28)]), (1, "+", [(0, 29)])]), genome(spark, text)).collect()] == [1]
    assert [r.tx for r in checks.short_coding(annotation(spark, good), 13).collect()] == [0]


def test_histogram(spark):
    rows = spark.createDataFrame([("=", 0), ("=", 300), ("=", 150), ("c", 99)], "class_code string, len long")
    got = {(r.class_code, r.bin): (r.lo, r.hi, r.n) for r in histograms.histogram(rows, "len", 3).collect()}
    assert got == {("=", 0): (0, 100, 1), ("=", 1): (100, 200, 1), ("=", 2): (200, 300, 1), ("c", 0): (0, 100, 1), ("c", 1): (100, 200, 0), ("c", 2): (200, 300, 0)}
    same = spark.createDataFrame([("a", 5.5), ("a", 5.5)], "class_code string, v double")
    assert [r.n for r in histograms.histogram(same, "v", 2).orderBy("bin").collect()] == [0, 2]
    assert histograms.histogram(rows.limit(0), "len", 3).collect() == []


def test_comparison(spark):
    ref = annotation(spark, [(0, "+", [(10, 20), (30, 40)]), (1, "-", [(50, 60)]), (2, "+", [(100, 110)])])
    qry = annotation(spark, [(0, "+", [(10, 20), (30, 40)]), (1, "-", [(50, 62)])]).withColumn("annotation", F.lit("q"))
    got = {r.level: (r.sensitivity, r.precision) for r in comparison.compare(qry, ref).collect()}
    assert got == {"base": (0.75, round(30 / 32, 3)), "exon": (0.5, round(2 / 3, 3)), "intron": (1.0, 1.0), "intron_chain": (1.0, 1.0), "transcript": (0.333, 0.5), "locus": (0.333, 0.5)}
    near = {r.level: (r.sensitivity, r.precision) for r in comparison.compare(qry, ref, tolerance=2).collect()}
    assert near["transcript"] == near["locus"] == (0.667, 1.0)
    extra = {r.level: (r.missed, r.novel) for r in comparison.missed_and_novel(qry, ref).collect()}
    assert extra == {"exon": (0.25, 0.0), "locus": (0.333, 0.0)}
    assert histograms.f1_curve(spark, 0.5).where("recall > 1 OR precision > 1").count() == 0
