"""The corpus pipeline: each stage is written as Parquet and reread as the documents of the next.

All stages take any rows: a null text is an empty one, ids may be null or repeat, further columns are kept (but by the last stage),
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.decontaminate import without_leaks
from strandline.llm.line_chunks import line_dedup
from strandline.llm.near_dups import keep_one_each
from strandline.llm.quality_votes import keep_good
from strandline.llm.queries import bpe_digests
from strandline.llm.storage import Workspace

NEAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote them good; texts without words are judged by the mean of the labels, 0.5 if there are none.

    A row's id finds its label, if it has one; rows with null or repeated ids are judged by their texts like any other.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks and passages that an earlier one has; a document of which nothing is left goes.

    Texts that were empty before stay, since nothing was removed of them; n_chars is counted anew.
    """
    done = line_dedup(docs).where(r"n_removed = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; sets link that share NEAR per cent of their union.

    Of equal texts the least id stays, rows without id last; each row without words stays, for it is like no other.
    """
    return keep_one_each(docs, link=NEAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty texts hold none, and items without id or words are held by none."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded text; an empty text has no tokens."""
    return bpe_digests(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_bpe", bpe_stage),
]

#: The quality classifier is trained, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, writing and rereading after each but the last.

    The tables that a stage works with, and the documents it was given, are removed once its own are written.
    """
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        begin = Workspace.mark()
        docs = space.keep(stage(spark, docs, sf_dir))
        Workspace.drop_since(begin)
        space.drop_all_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
