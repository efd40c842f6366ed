"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .decontaminate import benchmark_leaks
from .jaccard_join import jaccard_components
from .line_chunks import line_dedup
from .near_dups import near_dup_components
from .oracles import divergence_sql, secrets_sql, similar_sql, url_sql
from .pseudonyms import pseudonymise
from .quality_rules import RULES as QUALITY_RULES
from .quality_rules import STOP_WORDS, compiled, quality_rules
from .quality_votes import quality_scores
from .secret_ledger import BASE_RULES, RULES, scan_secrets, secret_digests
from .source_divergence import source_divergence
from .storage import shared_dir
from .token_alignment import token_alignment
from .token_counts import token_counts, vocabulary_of
from .url_filter import url_verdicts


#: The registered query is to give the same rows everywhere, so its key is no secret; a real run passes its own.
PUBLIC_KEY = "public key of the registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary_of(public_tokenizers.path("piece_bpe_32k.model")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_components(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the second finds every blob scanned for the base rules and scans it for the others only."""
    docs, ledger = _table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    scan_secrets(docs, rules=BASE_RULES, ledger=ledger)
    return secret_digests(scan_secrets(docs, rules=RULES, ledger=ledger))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encodes and decodes every text, and digests both results."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe_encode(docs, ranks, public_tokenizers.PATTERN, decode=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), PUBLIC_KEY)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "removed_lines")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return token_alignment(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_quality_votes": op9_quality_votes,
    "op10_secret_ledger": op10_secret_ledger,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_alignment": op12_token_alignment,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": similar_sql(85, ", doc_id = component_id AS kept"),
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i,
    len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents
), h AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l
), e AS (
  SELECT *, i = n OR (31 * coalesce(lag(h) OVER d, 0) + h) % 2 = 0 OR words >= 50 OR coalesce(lead(words) OVER d, 0) >= 50 AS is_end FROM h
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), p AS (
  SELECT *, coalesce(sum(CAST(is_end AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e
), c AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS chunk, min(i) AS low, max(i) AS high, sum(words) AS words FROM p GROUP BY doc_id, place
), later_chunks AS (
  SELECT doc_id, low, high FROM c WHERE (high > low OR words >= 50) AND words > 0 QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, low) > 1
), w AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS after, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
    lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before_i FROM h WHERE words > 0 AND line IN (SELECT line FROM h GROUP BY line HAVING count(*) > 1)
), ends AS (
  SELECT a.doc_id, a.i AS low, (SELECT min(b.i) FROM w b WHERE b.doc_id = a.doc_id AND b.i >= a.i AND b.after >= a.after - a.words + 50) AS high FROM w a
  UNION
  SELECT b.doc_id, (SELECT max(a.i) FROM w a WHERE a.doc_id = b.doc_id AND a.i <= b.i AND a.after - a.words <= b.after - 50), b.i FROM w b
), runs AS (
  SELECT e.doc_id, e.low, e.high, string_agg(h.line, chr(10) ORDER BY h.i) AS run FROM ends e JOIN h ON h.doc_id = e.doc_id AND h.i BETWEEN e.low AND e.high
  WHERE e.low IS NOT NULL AND e.high IS NOT NULL GROUP BY ALL
), firsts AS (
  SELECT *, first_value(doc_id) OVER f AS first_doc, first_value(low) OVER f AS first_low, first_value(high) OVER f AS first_high FROM runs WINDOW f AS (PARTITION BY run ORDER BY doc_id, low)
), gone AS (
  SELECT doc_id, low, high FROM later_chunks UNION
  SELECT doc_id, CASE WHEN doc_id = first_doc THEN greatest(low, first_high + 1) ELSE low END, high FROM firsts WHERE (doc_id, low) <> (first_doc, first_low)
), g AS (
  SELECT h.doc_id, h.i, h.line, EXISTS (SELECT 1 FROM gone x WHERE x.doc_id = h.doc_id AND h.i BETWEEN x.low AND x.high) AS gone FROM h
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM g
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
  count(*) FILTER (starts) AS n_removed, count(*) FILTER (gone) AS removed_lines FROM s GROUP BY doc_id
""",
    "op7_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) AS tri FROM d
), c AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM c WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_intersect(w, {STOP_WORDS!r})) AS n_stop_words,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations
  FROM d LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {compiled(QUALITY_RULES)} AS kept FROM b
""",
    "op8_url_filter": url_sql(),
    "op10_secret_ledger": secrets_sql(),
    "op11_source_divergence": divergence_sql(),
    "op13_jaccard_join": similar_sql(80, ""),
}
