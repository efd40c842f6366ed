"""Lookups, classification and interval plans against plain loops, and at the length of a chromosome."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import checks, comparison, intervals, sequences
from strandline.plans.annotate import annotate_groups, annotate_genome
from strandline.sources import readers, writers

TX = "seq string, strand string, tx long, gene long, cds array<struct<start:bigint,end:bigint>>"


def random_transcripts(rng, n, span, genes):
    rows = []
    for tx in range(n):
        at, cds = rng.randrange(span), []
        for _ in range(rng.randrange(1, 5)):
            stop = at + rng.randrange(1, 60)
            cds.append((at, stop))
            at = stop + rng.randrange(1, rng.choice([30, 3000]))
        gene = rng.randrange(genes)
        rows.append((f"c{gene % 2}", "+-"[gene // 2 % 2], tx, gene, cds))
    return rows


def brute_labels(rows, seq, pos):
    out = {}
    for strand in "+-":
        genes = {}
        for s, st, _, gene, cds in rows:
            if (s, st) == (seq, strand):
                genes.setdefault(gene, []).append(cds)
        over = [(min(c[0][0] for c in isoforms), g) for g, isoforms in genes.items() if any(c[0][0] <= pos < c[-1][1] for c in isoforms)]
        if not over:
            out[strand] = "intergenic"
        else:
            out[strand] = "cds" if any(a <= pos < b for c in genes[min(over)[1]] for a, b in c) else "intron"
    return out["+"], out["-"]


@pytest.mark.parametrize("top", [2, 10])
def test_classification_matches_brute_force(spark, monkeypatch, top):
    """Genes with gaps between isoforms, deep overlaps, spans of many levels, and positions outside of all."""
    monkeypatch.setattr(intervals, "TOP", top)
    rng = random.Random(top)
    rows = random_transcripts(rng, 150, 6000, 40)
    points = [(k, f"c{rng.randrange(3)}", rng.randrange(-50, 15000)) for k in range(1500)]
    got = intervals.classify_positions(spark.createDataFrame(points, "pos_id long, seq string, pos long"), spark.createDataFrame(rows, TX))
    assert {r.pos_id: (r.fwd, r.rev) for r in got.collect()} == {k: brute_labels(rows, s, p) for k, s, p in points}


def test_spans_are_cut_to_the_levels_that_positions_ask_for(spark, monkeypatch):
    """A span of 64 positions is one piece of level 3, which no position asks for when levels end at 1."""
    monkeypatch.setattr(intervals, "TOP", 1)
    transcripts = spark.createDataFrame([("c", "+", 1, 1, [(64, 128)])], TX)
    points = spark.createDataFrame([(0, "c", 63), (1, "c", 64), (2, "c", 127), (3, "c", 128)], "pos_id long, seq string, pos long")
    got = intervals.deciding_genes(points, transcripts).where("plus IS NOT NULL").collect()
    assert sorted(r.pos_id for r in got) == [1, 2]


def test_pieces_cover_an_interval_once(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.choice([1, 2, 5, 63, 64, 65, 1000, 5 * 10**6])) for a in (rng.randrange(10**6) for _ in range(60))]
    rows = spark.createDataFrame(spans, "low long, high long").select("low", "high", intervals.aligned_pieces(F.col("low"), F.col("high")).alias("p")).collect()
    for r in rows:
        pieces = sorted((x.node * 4**x.level, (x.node + 1) * 4**x.level) for x in r.p)
        assert pieces[0][0] == r.low and pieces[-1][1] == r.high and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert len(pieces) <= 6 * 11 + (r.high - r.low) // 4**10


def test_islands_across_bins(spark):
    rng = random.Random(4)
    rows = [("c", a, a + rng.randrange(1, 40)) for a in (rng.randrange(3000) for _ in range(150))]
    frame = spark.createDataFrame(rows, "seq string, low long, high long")
    for touching in (True, False):
        expected, reach = [], None
        for _, a, b in sorted(rows):
            if reach is None or (a > reach if touching else a >= reach):
                island, reach = a, b
            reach = max(reach, b)
            expected.append((a, b, island))
        for width in (16, 10**6):
            got = intervals.islands(frame, ["seq"], "low", "high", touching, width).collect()
            assert sorted((r.low, r.high, r._island) for r in got) == sorted(expected)


def test_letters_across_chunks(spark):
    rng = random.Random(5)
    texts = {"c0": "".join(rng.choice("ACGTacgtN") for _ in range(7001)), "c1": "ACGTAC", "c2": ""}
    genome = spark.createDataFrame([(n, k, s) for k, (n, s) in enumerate(texts.items())], "name string, seq_ord long, sequence string")
    rows = [r for r in random_transcripts(rng, 60, 6000, 20) if r[0] in texts]
    frame = spark.createDataFrame([*rows, ("none", "+", 999, 999, [(0, 3)]), ("c1", "+", 1000, 1000, [])], TX)
    for size in (7, 64, 16384):
        got = {r.tx: r.coding for r in checks.coding_sequences(frame, genome, size).collect()}
        expected = {}
        for seq, strand, tx, _, cds in rows:
            joined = "".join(texts[seq][a:b] for a, b in cds)
            expected[tx] = joined if strand == "+" else joined[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
        assert got == expected


def test_a_long_contig_with_many_transcripts(spark):
    """Fifty million letters and 100,000 transcripts: rows between joins carry chunks, never the contig."""
    n = 50_000_000
    genome = spark.range(1).select(F.lit("c0").alias("name"), F.col("id").alias("seq_ord"), F.repeat(F.lit("ACGTG"), n // 5).alias("sequence"))
    block = F.struct((F.col("id") * 499).alias("start"), (F.col("id") * 499 + 9).alias("end"))
    rows = spark.range(100_000).select(F.lit("c0").alias("seq"), F.lit("+").alias("strand"), F.col("id").alias("tx"), F.col("id").alias("gene"), F.array(block).alias("cds"))
    made = checks.coding_sequences(rows, genome)
    whole = "ACGTG" * 3
    kinds = made.groupBy((F.col("tx") * 499 % 5).alias("at"), "coding").count().collect()
    assert sum(r["count"] for r in kinds) == 100_000 and all(r.coding == whole[r["at"] : r["at"] + 9] for r in kinds)


def test_index_of_sequences_on_disk(spark, tmp_path):
    """Block gzip is gzip of several members; it is read, indexed and fetched from."""
    texts = {"a": "ACGT" * 30, "b": "GGC"}
    lines = "".join(f">{n} more\n{s[:50]}\n{s[50:]}\n" for n, s in texts.items()).encode()
    path = tmp_path / "genome.fa.gz"
    path.write_bytes(b"".join(gzip.compress(lines[k : k + 37]) for k in range(0, len(lines), 37)))
    read = readers.read_fasta(spark, f"file://{path}")
    sequences.write_chunks(read, f"file://{tmp_path}/index", 16)
    index = spark.read.parquet(f"file://{tmp_path}/index")
    ranges = spark.createDataFrame([(1, "a", 0, 10, 90), (1, "a", 1, 118, 120), (2, "b", 0, 0, 3)], "fetch_id long, seq string, part long, start long, end long")
    got = {r.fetch_id: (r["name"], r.sequence) for r in sequences.fetch_indexed(index, ranges, 16).collect()}
    assert got == {1: ("a:11-90,119-120", texts["a"][10:90] + "GT"), 2: ("b:1-3", "GGC")}
    with pytest.raises(Exception, match="outside"):
        sequences.fetch_indexed(index, ranges.where("fetch_id = 2").withColumn("end", F.lit(4).cast("long")), 16).collect()
    assert {r.seq: r.length for r in sequences.lengths_of_chunks(index, 16).collect()} == {"a": 120, "b": 3}


def test_class_codes_by_hand(spark):
    reference = spark.createDataFrame([("c", "+", 1, 1, [(1000, 1100), (1200, 1300), (1400, 1500)])], TX)
    cases = {
        "=": ("+", [(1000, 1100), (1200, 1300), (1400, 1500)]), "c": ("+", [(1250, 1300), (1400, 1450)]), "k": ("+", [(900, 950), (980, 1100), (1200, 1300), (1400, 1550)]),
        "j": ("+", [(1050, 1100), (1200, 1350), (1380, 1450)]), "e": ("+", [(1050, 1150)]), "o": ("+", [(1290, 1305), (1390, 1410)]), "s": ("-", [(1050, 1100), (1200, 1250)]),
        "x": ("-", [(1050, 1150)]), "i": ("-", [(1120, 1180)]), "y": ("-", [(900, 950), (1600, 1700)]), "p": ("+", [(1600, 1700)]), "u": ("+", [(9000, 9100)]),
    }
    rows = [("c", strand, k, k, cds) for k, (strand, cds) in enumerate(cases.values())]
    got = {r.qry_id: r for r in comparison.class_codes(spark.createDataFrame(rows, TX), reference).collect()}
    assert {code: got[k].class_code for k, code in enumerate(cases)} == {code: code for code in cases}
    assert got[0].len == got[0].ref_match_len == 300 and got[11].ref_id is None and got[4].num_exons == 1


def test_class_codes_of_retained_introns_and_repeats(spark):
    reference = spark.createDataFrame([("c", "+", 1, 1, [(1000, 1100), (1200, 1300), (1400, 1500)]), ("c", "+", 7, 7, [(1000, 1100), (1200, 1300), (1400, 1500)])], TX)
    cases = [
        ("m", "+", [(1050, 1300), (1400, 1450)]), ("m", "+", [(950, 1600)]), ("n", "+", [(1050, 1350)]), ("n", "+", [(1050, 1100), (1210, 1450)]), ("x", "-", [(1050, 1350)]),
        ("r", "+", [(9000, 9010)]), ("u", "+", [(9005, 9013)]), ("r", "-", [(9000, 9004), (9008, 9012)]), ("u", "+", [(20_000, 20_010)]),
    ]
    rows = [("c", strand, k, k, cds) for k, (_, strand, cds) in enumerate(cases)]
    genome = spark.createDataFrame([("c", 0, "A" * 9000 + "acgta" + "A" * 5 + "acgt" * 2 + "A" * 100)], "name string, seq_ord long, sequence string")
    made = {r.qry_id: r for r in comparison.class_codes(spark.createDataFrame(rows, TX), reference, sequences=genome).collect()}
    assert [made[k].class_code for k in range(len(cases))] == [c for c, _, _ in cases]
    assert made[0].ref_id == 1 and made[5].ref_id is None
    without = {r.class_code for r in comparison.class_codes(spark.createDataFrame(rows[5:], TX), reference).collect()}
    assert without == {"u"}


def test_equal_transcripts_of_one_locus_meet_by_their_introns(spark):
    """Many transcripts over one place: those with an equal reference, and repeated ones, make no pair for each two."""
    n = 3000
    rows = spark.range(n).select(F.lit("c").alias("seq"), F.lit("+").alias("strand"), F.col("id").alias("tx"), F.lit(1).cast("long").alias("gene"), F.expr("array(struct(1000L AS start, 1100L + id AS end), struct(9000L AS start, 9100L AS end))").alias("cds"))
    found = comparison.class_codes(rows.unionByName(rows.withColumn("tx", F.col("tx") + n)), rows)
    assert [tuple(r) for r in found.groupBy("class_code").count().collect()] == [("=", 2 * n)]
    assert found.where("qry_id % 3000 <> ref_id").count() == 0


def test_tmap_names_and_paths(spark):
    rows = spark.createDataFrame([("=", "10", "1"), ("c", "20", "3")], "class_code string, len string, num_exons string")
    got = readers.tmap_histograms(rows, ["Length", "num_exons"], 2).collect()
    assert {r.column for r in got} == {"Length", "num_exons"} and sum(r.n for r in got) == 4
    with pytest.raises(ValueError, match="no column"):
        readers.tmap_histograms(rows, ["Width"], 2)
    assert writers.tmap_paths("t", 1) == ["t"] and writers.tmap_paths("t", 2) == ["t_0", "t_1"]
    with pytest.raises(ValueError):
        writers.tmap_paths(["a"], 2)


def stub():
    def predict(chunks):
        size = F.length("chunk")
        coding = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when((i >= 2) & (i < 8), 4).otherwise(0))
        return chunks.select(F.col("name").alias("seq"), F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), F.col("chunk_no").cast("long").alias("chunk_no"), coding.alias("states"))

    return predict


def test_groups_of_chunk_sizes(spark, tmp_path):
    lengths = {"a": 100, "b": 95, "c": 20, "d": 18}
    genome = spark.createDataFrame([(n, k, "A" * size) for k, (n, size) in enumerate(lengths.items())], "name string, seq_ord long, sequence string")
    found = annotate_groups(genome, stub(), 50, delta=0.5, factors=[2])
    got = sorted((r.seq, r.strand, r.cds[0].start, r.cds[0].end) for r in found.collect())
    assert got == sorted((n, s, at, at + 6) for n, starts in {"a": (2, 52), "b": (2, 52), "c": (2,), "d": (2,)}.items() for at in starts for s in "+-")
    assert sorted(r.tx for r in found.collect()) == list(range(1, 13))
    sums = annotate_genome(genome, stub(), f"file://{tmp_path}/out.gtf.gz", 50, min_sequence_size=1, delta=0.5, factors=[2])
    assert sums["predicted_genes"] == sums["genes"] == 12
    assert spark.read.text(f"file://{tmp_path}/out.gtf.gz").where("value LIKE '%\tgene\t%'").count() == 12
