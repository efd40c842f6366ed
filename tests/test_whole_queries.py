"""The whole queries leave no transcript, contig end or code out."""

from pyspark.sql import functions as F

from strandline import fixtures as fx
from strandline.functions.codons import AMINO_ACIDS, codon_frame, is_codon_distribution
from strandline.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_transcript_within_its_contig_is_fetched(spark):
    sizes = {r["name"]: r["n"] for r in fx.genome(spark).select("name", F.length("sequence").alias("n")).collect()}
    blocks = [r for r in fx.blocks(spark, DATA).collect() if r.cds_end <= sizes[r.seq]]
    got = {r.fetch_id: r["name"].count("-") for r in QUERIES["fetch_ranges_whole"](spark, DATA).collect()}
    assert got == {t: sum(r.tx == t for r in blocks) for t in {r.tx for r in blocks}}
    assert any(r.cds_end > 52000 for r in blocks)


def test_all_codes_and_their_distributions(spark):
    assert len(AMINO_ACIDS) == 27 and codon_frame(spark).count() == 27 * 64
    codons = codon_frame(spark)
    for kind in ("start", "stop"):
        rows = codons.select("translation_table", "codon", F.col(f"{kind}_prob").alias("prob")).where("prob > 0")
        assert is_codon_distribution(rows, by=("translation_table",)).where("valid").count() == 27
        halved = rows.withColumn("prob", F.col("prob") / 2)
        assert is_codon_distribution(halved, by=("translation_table",)).where("NOT valid").count() == 27
    assert {r.translation_table for r in QUERIES["codon_table"](spark, DATA).collect()} == set(AMINO_ACIDS)
    assert {r.valid for r in QUERIES["codon_distributions_valid"](spark, DATA).collect()} == {True, False}
