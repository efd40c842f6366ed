"""Structured Streaming forms: sequences or positions arrive as files, each micro-batch goes through the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.intervals import classify_positions
from ..operators.transcripts import numbered
from ..sources.appends import Commit, commit, last_commit


def classified_stream(positions: DataFrame, transcripts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Labels of streamed positions (pos_id, seq, pos), written as Parquet; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        classify_positions(batch, transcripts).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return positions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def annotated_stream(sequences: DataFrame, annotate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Transcripts of streamed sequences.  Gene ids are (batch, place), so numbering carries on without shared state."""

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return sequences.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered_stream(sequences: DataFrame, annotate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, first_gene_id: int = 1) -> StreamingQuery:
    """Transcripts of streamed sequences with gene ids that run on over batches, as Parquet in a folder for each batch.

    After a batch has been written its manifest keeps the next id, and the next batch counts from there.  A batch that runs again,
    after a failure for instance, begins where it began before and overwrites its own folder; so each gene has one id, whatever
    happens in between.  Batches in order of their sequences get the ids of one run over all.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = last_commit(spark, target, before=number + 1)
        first = last.next_gene_id if last else first_gene_id
        folder = f"{target}/batch={number}"
        numbered(annotate(batch), first).write.mode("overwrite").parquet(folder)
        most = spark.read.parquet(folder).agg(F.max("gene_id")).first()[0]
        commit(spark, target, Commit(number + 1, first if most is None else most + 1))

    return sequences.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_counts(labelled: DataFrame, time: str = "ts", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts of labels by window of event time; rows later than ``lateness`` are left out by the watermark."""
    return labelled.withWatermark(time, lateness).groupBy(F.window(time, width), "fwd", "rev").agg(F.count("*").alias("n"))


def parquet_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
