"""Transcripts of one structure are compared together, each of them counts."""

from strandline.operators import comparison

CDS = "array<struct<start:long,end:long>>"


def test_copies_of_a_structure_make_one_pair(spark):
    copies = ["'a' AS seq", "'+' AS strand", "id AS tx", "array(struct(10L AS start, 20L AS end), struct(40L AS start, 60L AS end)) AS cds"]
    query = spark.range(3_000).selectExpr("'q' AS annotation", *copies)
    query = query.unionByName(spark.createDataFrame([("q", "a", "+", 9_000, [(12, 22)]), ("q", "b", "-", 9_001, [(0, 6), (9, 12)])], f"annotation string, seq string, strand string, tx long, cds {CDS}"))
    reference = spark.range(2_000).selectExpr(*copies)
    reference = reference.unionByName(spark.createDataFrame([("a", "+", 8_000, [(10, 24)]), ("a", "+", 8_001, [(100, 124)])], f"seq string, strand string, tx long, cds {CDS}"))
    assert comparison._structure_matches(comparison._structures(query, ["annotation"]), comparison._structures(reference, []), 2).count() == 2
    got = {r.level: (r.sensitivity, r.precision) for r in comparison.compare(query, reference, 2).collect()}
    assert got["transcript"] == (1.0, round(3_001 / 3_002, 3)) == (1.0, 1.0)
    assert got["locus"] == (0.5, 0.5) and got["exon"] == (0.5, 0.4) and got["intron"] == (1.0, 0.5) and got["intron_chain"] == (1.0, 0.5)
    assert got["base"] == (round(32 / 58, 3), round(32 / 41, 3))
