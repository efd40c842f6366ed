"""Views that read the driver's tables as genomes: coding blocks from lineitem, positions and labels from events, class codes from
orders, sequences from documents or from arithmetic.  Each has a Spark form and the SQL of the same rows for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.transcripts import nested

CONTIGS, BASE_LENGTH, STEP = 7, 52_000, 500


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """(seq, strand, tx, gene, cds_start, cds_end).  (l_orderkey, l_linenumber) repeats in the data, hence the grouping."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber")
    rows = rows.agg(F.min("l_partkey").alias("p"), F.min(F.col("l_quantity").cast("long")).alias("q"))
    begin = (F.col("l_orderkey") * 37) % 50000 + F.col("l_linenumber") * 600 + F.col("p") % 300
    return rows.select(
        F.concat(F.lit("chr"), F.col("l_orderkey") % 7).alias("seq"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("l_orderkey").alias("tx"),
        F.expr("l_orderkey div 42 * 14 + l_orderkey % 14").alias("gene"), begin.cast("long").alias("cds_start"), (begin + 3 * F.col("q")).cast("long").alias("cds_end"),
    )


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return nested(blocks(spark, d), ("seq", "strand", "tx", "gene"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("pos_id"), F.concat(F.lit("chr"), F.col("user_id") % 7).alias("seq"), ((F.col("event_id") * 7919) % 55000).alias("pos"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(seq, strand, idx, state)."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    state = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 5).otherwise(14)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("seq"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"), place.cast("long").alias("idx"), state.alias("state"))


def class_codes(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("qry_id"), F.col("o_orderstatus").alias("class_code"), F.floor("o_totalprice").cast("long").alias("len"), (1 + F.col("o_orderkey") % 9).alias("num_exons"))


def genome(spark: SparkSession) -> DataFrame:
    """(name, seq_ord, sequence): seven contigs by arithmetic."""
    letter = "substr('ACGTacgtN', CAST(1 + (((p * 7919 + c * 104729) % 10007) * (p % 13 + 1)) % 9 AS INT), 1)"
    return spark.range(CONTIGS).select(
        F.expr("concat('chr', id)").alias("name"), F.col("id").alias("seq_ord"),
        F.expr(f"transform(array(id), c -> concat_ws('', transform(sequence(0L, {BASE_LENGTH - 1} + {STEP} * c), p -> {letter})))[0]").alias("sequence"),
    )


def document_sequences(spark: SparkSession, d: str) -> DataFrame:
    """(name, seq_ord, sequence): documents with all but nucleotide letters as N."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select(F.col("doc_id").cast("string").alias("name"), F.col("doc_id").alias("seq_ord"), F.regexp_replace("text", "[^ACGTacgt]", "N").alias("sequence"))


#: The same as common table expressions for DuckDB.
SQL = {
    "cds": """cds AS (
  SELECT concat('chr', l_orderkey % 7) AS seq, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_orderkey AS tx, l_orderkey // 42 * 14 + l_orderkey % 14 AS gene,
    (l_orderkey * 37) % 50000 + l_linenumber * 600 + min(l_partkey) % 300 AS cds_start,
    (l_orderkey * 37) % 50000 + l_linenumber * 600 + min(l_partkey) % 300 + 3 * min(CAST(l_quantity AS BIGINT)) AS cds_end
  FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "tx": """tx AS (
  SELECT seq, strand, tx, gene, min(cds_start) AS s, max(cds_end) AS e, sum(cds_end - cds_start) AS len, count(*) AS n,
    string_agg(concat(cds_start, '-', cds_end), ',' ORDER BY cds_start) AS blocks FROM cds GROUP BY ALL)""",
    "pos": "pos AS (SELECT event_id AS pos_id, concat('chr', user_id % 7) AS seq, (event_id * 7919) % 55000 AS pos FROM events)",
    "labels": """labels AS (
  SELECT CAST(user_id AS VARCHAR) AS seq, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 ELSE 14 END AS state FROM events)""",
    "tmap": "tmap AS (SELECT o_orderkey AS qry_id, o_orderstatus AS class_code, CAST(floor(o_totalprice) AS BIGINT) AS len, 1 + o_orderkey % 9 AS num_exons FROM orders)",
    "genome": f"""genome AS (
  SELECT concat('chr', c) AS name, c AS seq_ord, string_agg(substr('ACGTacgtN', CAST(1 + (((p * 7919 + c * 104729) % 10007) * (p % 13 + 1)) % 9 AS INT), 1), '' ORDER BY p) AS sequence
  FROM (SELECT c, unnest(range(0, {BASE_LENGTH} + {STEP} * c)) AS p FROM range({CONTIGS}) t(c)) GROUP BY c)""",
    "docs": "docs AS (SELECT CAST(doc_id AS VARCHAR) AS name, doc_id AS seq_ord, regexp_replace(text, '[^ACGTacgt]', 'N', 'g') AS sequence FROM documents)",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
