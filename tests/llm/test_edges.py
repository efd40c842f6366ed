"""Nulls, empty and long texts, repeated rows, empty tables and extra columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import queries
from strandline.llm.bpe import bpe_encode
from strandline.llm.decontaminate import benchmark_leaks
from strandline.llm.jaccard_join import jaccard_components
from strandline.llm.line_chunks import line_dedup
from strandline.llm.near_dups import near_dup_components
from strandline.llm.pseudonyms import pseudonymise
from strandline.llm.quality_rules import quality_rules
from strandline.llm.quality_votes import quality_scores
from strandline.llm.secret_ledger import scan_secrets
from strandline.llm.source_divergence import source_divergence
from strandline.llm.token_alignment import token_alignment
from strandline.llm.token_counts import token_counts, vocabulary_of
from strandline.llm.url_filter import url_verdicts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "word token=abcdef123 " * 60_000
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f"), (None, None), (3, ""), (4, LONG), (5, "line one\nline two\nline one\nline two"), (5, "other")]
CLASH = ("cls", "key", "row", "place", "score", "spans", "blob", "n", "hub", "w", "t", "block", "predicted", "n_tokens", "label", "row_key", "a.dot", "`quoted`", "_near_dup_key", "chunk", "owner", "spare", "bits", "root")


def docs(spark, rows=ROWS):
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return made.withColumns({c: F.lit(1) for c in CLASH})


def labels(spark, rows=((1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (7, None, None), (8, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, "a b c d e f"), (None, "x y z"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "token_counts": lambda s, d: token_counts(d, vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))),
    "near_dups": lambda s, d: near_dup_components(d),
    "bpe": lambda s, d: bpe_encode(d, RANKS, public_tokenizers.PATTERN),
    "pseudonyms": lambda s, d: pseudonymise(d, "k"),
    "line_dedup": lambda s, d: line_dedup(d),
    "quality_rules": lambda s, d: quality_rules(d),
    "urls": lambda s, d: url_verdicts(d, "doc_id", "text"),
    "votes": lambda s, d: quality_scores(d, labels(s)),
    "votes_without_labels": lambda s, d: quality_scores(d, labels(s).limit(0)),
    "secrets": lambda s, d: scan_secrets(d),
    "alignment": lambda s, d: token_alignment(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN),
    "jaccard": lambda s, d: jaccard_components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_a_result(spark, name):
    made = OPERATORS[name](spark, docs(spark))
    key = made.columns[0] if "doc_id" not in made.columns else "doc_id"
    ids = [r[key] for r in made.collect()]
    assert sorted(ids, key=str) == sorted((i for i, _ in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](spark, docs(spark).limit(0)).collect() == []


RUNS = [("x" * 10**6,), ("日" * 10**6,), ("0123456789abcdef" * 62_500,), ("ab " * 333_333,), ("a\n" * 20_000,), ("-" * 10**6,), (" " * 10**6,), ("http://h/" + "p" * 10**6,)]


@pytest.mark.parametrize("name", [*OPERATORS, "leaks"])
def test_very_long_texts(spark, name):
    """A million characters of one kind: with and without blanks, in one line and in many."""
    given = docs(spark, [(k, t) for k, (t,) in enumerate(RUNS)]).repartition(8)
    if name == "leaks":
        assert benchmark_leaks(given, benchmark(spark, ((1, "ab ab ab ab ab ab"),))).select("doc_id").collect() == [(3,)]
    else:
        assert len(OPERATORS[name](spark, given).collect()) == len(RUNS)


def test_leaks(spark):
    found = benchmark_leaks(docs(spark), benchmark(spark)).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 1), (1, 1), (1, 1)]
    assert benchmark_leaks(docs(spark), benchmark(spark).limit(0)).collect() == []
    assert benchmark_leaks(docs(spark).limit(0), benchmark(spark)).collect() == []


def test_results_of_odd_rows(spark):
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup_components(docs(spark)).collect()}
    assert {(1, 2, 1, True), (None, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True)} <= near
    lines = {(r.doc_id, r.text) for r in line_dedup(docs(spark)).collect()}
    assert (2, "") in lines and (4, LONG) in lines
    scores = {r.score for r in quality_scores(docs(spark), labels(spark).limit(0)).collect()}
    assert scores == {0.5}


@pytest.fixture
def folder(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, folder, stage, empty):
    given = docs(spark).limit(0) if empty else docs(spark)
    made = corpus_pipeline.STAGES[stage][1](spark, given, folder)
    rows = made.collect()
    if empty:
        assert rows == []
    if stage < 4:
        assert made.columns == given.columns
    elif not empty:
        assert len(rows) == len(ROWS)


def test_decisions_take_effect(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    left = stages["minhash_near_dedup"](spark, docs(spark), folder).collect()
    assert sum(r.text == "a b c d e f" for r in left) == 1
    clean = stages["benchmark_decontamination"](spark, docs(spark), folder).collect()
    assert not any(r.text == "a b c d e f" for r in clean) and len(clean) == len(ROWS) - 3
    assert len(corpus_pipeline.run(spark, folder).collect()) >= 1


def test_the_pipeline_on_real_tables(spark):
    d = "/root/testdata/sf0.001"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, d).collect()
    ids = [r.doc_id for r in rows]
    assert 0.5 * len(source) < len(ids) == len(set(ids)) and set(ids) <= set(source)
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert not any(item in source[i] for i in ids for item in items)


def test_registered_names():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert [k for k in range(len(corpus_pipeline.STAGES))] == [0, 1, 2, 3, 4]


def test_divergence_of_odd_rows(spark):
    """Each (lang, source) group has its pairs, whatever its texts are; no rows give none."""
    rows = docs(spark).withColumn("source", F.when(F.col("doc_id") > 2, F.lit("s")))
    got = source_divergence(rows).collect()
    assert [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in sorted(got)] == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]
    assert source_divergence(rows.limit(0)).count() == 0
