import pytest
from pyspark.sql import functions as F

from strandline.functions import nucleotides as nt
from strandline.functions.codons import AMINO_ACIDS, codon_frame, codon_map, is_codon_distribution, start_codons, stop_codons
from strandline.operators import sequences as sq


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(expression.alias("x")).first().x


def test_letters_and_codes(spark):
    s = F.col("s")
    assert one(spark, nt.encoded(s), s="ACGTNacgtUn\r") == "012345678444"
    assert one(spark, nt.decoded(F.lit("012345678")), s="") == "ACGTNacgt"
    assert one(spark, nt.decoded(F.lit("05"), repeats=False), s="") == "AA"
    assert one(spark, nt.complement(s), s="ACGTNacgt-") == "TGCANtgcaN"
    assert one(spark, nt.complement(nt.complement(s, True), True), s="AacGTNtt") == "AacGTNtt"
    assert one(spark, nt.is_repeat_masked(s), s="ACGn") is False
    assert one(spark, nt.name_of(s), s="chr1 more words") == "chr1"


def test_kmers(spark):
    s = F.col("s")
    assert one(spark, nt.kmers(s), s="atgaaTG") == ["ATG", "AAT"]
    assert one(spark, nt.kmer_codes(s), s="TGAN") == [208]
    assert one(spark, nt.overlapping_kmers(s), s="ACGT") == ["ACG", "CGT"]
    assert one(spark, nt.overlapping_kmers(s), s="AC") == []
    with pytest.raises(ValueError):
        nt.kmer_codes(s, 6)


def test_one_hot_widths(spark):
    s = F.col("s")
    assert [len(one(spark, nt.one_hot(s, repeats, unknown), s="Na")[0]) for repeats in ("track", "omit", "expand") for unknown in ("track", "uniform")] == [6, 5, 5, 4, 9, 8]
    assert one(spark, nt.one_hot(s), s="aN-") == [[1, 0, 0, 0, 0, 1], [0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 1, 0]]
    assert one(spark, nt.one_hot(s, "omit", "uniform"), s="N") == [[0.25] * 4]
    with pytest.raises(ValueError):
        nt.one_hot(s, "other")


def test_chunks_and_slices(spark):
    s = F.col("s")
    assert one(spark, nt.chunk_array(s, 4), s="ACGTAC") == ["ACGT", "AC--"]
    assert one(spark, nt.chunk_array(s, 4, True), s="ACGTAC") == ["ACGT"]
    assert one(spark, nt.chunk_array(s, 4), s="") == []
    assert one(spark, nt.slice_of(s, F.lit(12), F.lit(14), F.lit(10)), s="ACGT") == "GT"
    with pytest.raises(Exception, match="outside"):
        one(spark, nt.slice_of(s, F.lit(0), F.lit(5)), s="ACGT")
    assert nt.rounded_up(10, [9, 6]) == 18
    with pytest.raises(ValueError):
        nt.rounded_up(0, [3])


def test_coding_and_protein(spark):
    cds = F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((0, 6), (9, 12))))
    coding = nt.splice(F.col("s"), cds, F.lit("+"))
    assert one(spark, coding, s="ATGAAAGTCTAA") == "ATGAAATAA"
    assert one(spark, nt.protein(coding), s="ATGAAAGTCTAA") == "MK"
    minus = nt.splice(F.col("s"), F.slice(cds, 1, 1), F.lit("-"))
    assert one(spark, minus, s="ATGAAAGTCTAA") == "TTTCAT"
    assert one(spark, nt.protein(F.col("s"), drop_terminal_stop=False), s="atgNNNTGATAAC") == "MX**"
    assert one(spark, nt.protein(F.col("s"), 2), s="TGAAGA") == "W"
    with pytest.raises(Exception, match="multiple"):
        one(spark, nt.protein(F.col("s"), require_multiple_of_three=True), s="ATGA")


def test_codes_of_all_tables(spark):
    assert len(AMINO_ACIDS) == 27
    for table in AMINO_ACIDS:
        for codons in (start_codons(table), stop_codons(table)):
            assert abs(sum(p for _, p in codons) - 1) < 1e-9 and all(len(c) == 3 for c, _ in codons)
        if table not in (27, 28, 31):
            assert {c for c, a in codon_map(table).items() if a == "*"} == {c for c, _ in stop_codons(table)}
    with pytest.raises(ValueError):
        codon_map(7)
    assert codon_frame(spark).count() == 27 * 64
    bad = spark.createDataFrame([("ATG", 0.7), ("GTG", 0.2)], "codon string, prob double")
    assert is_codon_distribution(bad).first().valid is False


def contigs(spark, rows):
    return spark.createDataFrame([(n, k, s) for k, (n, s) in enumerate(rows)], "name string, seq_ord long, sequence string")


def test_fetch_index_and_totals(spark):
    rows = contigs(spark, [("a", "ACGTAC"), ("b", "GG"), ("c", "")])
    ranges = spark.createDataFrame([(1, "a", 0, 4, 6), (1, "a", 1, 0, 2)], "fetch_id long, seq string, part long, start long, end long")
    assert tuple(sq.fetch(rows, ranges).first()) == (1, "a:5-6,1-2", "ACAC")
    assert [r.name for r in sq.by_length(sq.index(rows, exclude=["c"], min_size=1)).collect()] == ["a", "b"]
    assert tuple(sq.totals(rows, 4).first()) == (3, 8, 3)
    assert sq.by_name(rows, "b").first().sequence == "GG" and [r.name for r in sq.slice_rows(rows, 1, 3).collect()] == ["b", "c"]
    assert sq.genome_shares(rows).first().share_g == 3 / 8
    assert sq.base_shares(rows).where("name = 'c'").first().share_a is None
    assert sq.any_masked(rows).first()[0] is False
    assert sq.renamed(rows, F.upper("name")).first().name == "A"
    assert sq.joined(rows, rows).first().sequence == "ACGTACACGTAC"
    with_evidence = rows.where("name = 'b'").withColumn("evidence", F.array(F.lit(1.0), F.lit(2.0)))
    assert [r.evidence for r in sq.evidence_chunks(with_evidence, 1).orderBy("chunk_no").collect()] == [[1.0], [2.0]]


def group_rows(spark, lengths, *options):
    rows = spark.createDataFrame([(f"s{k}", k, n) for k, n in enumerate(lengths)], "name string, seq_ord long, length long")
    return sorted(sq.grouped(rows, *options).collect(), key=lambda r: (-r.length, int(r.name[1:])))


def test_groups_by_hand(spark):
    # 100 and 60 fit chunks of 100; 40 is under half of that and sets chunks of 40, which 25 fits; 9 sets chunks of 9.
    got = group_rows(spark, [100, 60, 40, 25, 9], 100, 0.5)
    assert [(r.length, r.group_id, r.chunk_size) for r in got] == [(100, 0, 100), (60, 0, 100), (40, 1, 40), (25, 1, 40), (9, 2, 9)]
    # A group closes with the contig that takes it beyond 150 padded letters: 100 + 100, then 100 + 100, then 100.
    got = group_rows(spark, [100, 90, 90, 90, 80], 100, 0.5, None, 150)
    assert [r.group_id for r in got] == [0, 0, 1, 1, 2]
    # Rounded up to 32, a contig of 35 gives no smaller chunks than 40, so it joins and closes its group; so does the next one.
    got = group_rows(spark, [40, 35, 35, 10], 40, 0.95, [32])
    assert [(r.group_id, r.chunk_size) for r in got] == [(0, 40), (0, 40), (1, 40), (2, 32)]
    # The first chunk size is larger than everything.
    assert [(r.group_id, r.chunk_size) for r in group_rows(spark, [7, 7], 1000, 0.5)] == [(0, 7), (0, 7)]
    assert group_rows(spark, [], 100) == []


@pytest.mark.parametrize("factors,limit", [(None, None), ([9], None), (None, 300), ([4, 6], 500), ([50], 120)])
def test_groups_keep_their_rules(spark, factors, limit):
    """Many contigs of one length among them; every rule is checked on the result."""
    delta, first = 0.5, 100
    lengths = sorted([900, 400, 90, 88, 40, 39, 12, 9, 3, 2, 1, 1] + [40] * 25 + [7] * 30, reverse=True)
    got = group_rows(spark, lengths, first, delta, factors, limit)
    assert [r.length for r in got] == lengths
    least = 1 if factors is None else nt.rounded_up(1, factors)
    ids = [r.group_id for r in got]
    assert ids == sorted(ids) and set(ids) == set(range(ids[-1] + 1))
    for g in set(ids):
        own = [r for r in got if r.group_id == g]
        size = own[0].chunk_size
        assert all(r.chunk_size == size for r in own)
        padded = [-(-r.length // size) * size for r in own]
        short = [r.length < delta * size and size > least for r in own]
        assert not any(short[:-1]), "a short contig is the last of its group"
        assert limit is None or sum(padded[:-1]) <= limit, "a group closes with the contig that takes it beyond the limit"
        before = next((r for r in reversed(got) if r.group_id < g), None)
        if before is None or before.chunk_size != size:
            rounded = own[0].length if factors is None else nt.rounded_up(own[0].length, factors)
            assert size == (first if rounded >= first or own[0].length >= delta * first else rounded), "a new size is the length of its first contig"
        else:
            last = [r for r in got if r.group_id == g - 1]
            full = limit is not None and sum(-(-r.length // size) * size for r in last) > limit
            assert full or last[-1].length < delta * size, "a group of one size ends for a reason"
