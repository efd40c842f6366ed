"""Set operations on transcripts by structure (sequence, strand and blocks); names do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import STRUCTURE


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Transcripts of ``a`` that ``b`` has too; repeated ones stay repeated."""
    return a.join(b.select(*STRUCTURE), list(STRUCTURE), "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Transcripts of ``a`` that ``b`` lacks; repeated ones stay repeated."""
    return a.join(b.select(*STRUCTURE), list(STRUCTURE), "left_anti")


def union(a: DataFrame, b: DataFrame, order: str = "tx") -> DataFrame:
    """Transcripts of both, each once: the first by side, then ``order``."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    first = F.min_by(F.struct(*(c for c in both.columns if c not in STRUCTURE)), F.struct("_side", order))
    return both.groupBy(*STRUCTURE).agg(first.alias("t")).select(*STRUCTURE, "t.*").drop("_side").select(*a.columns)


def without(rows: DataFrame, gone: DataFrame, key: str = "tx") -> DataFrame:
    """Rows whose key is not among ``gone``: removal is by identity, not by structure."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def distinct_structures(rows: DataFrame) -> DataFrame:
    return rows.select(*STRUCTURE).distinct()


def equal_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_gene, b_gene) of genes with the same sequence, strand and set of transcripts."""

    def keys(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("seq", "strand", "gene").agg(F.array_sort(F.collect_set("cds")).alias("structures")).withColumnRenamed("gene", name)

    return keys(a, "a_gene").join(keys(b, "b_gene"), ["seq", "strand", "structures"]).select("a_gene", "b_gene")


# Annotations that are asked for again and again: written in buckets of their structure, so that no operation moves rows.


def structure_key(seq: str = "seq", strand: str = "strand", cds: str = "cds") -> Column:
    """A text that two transcripts share exactly if their structures are equal: strand, blocks and sequence."""
    blocks = F.array_join(F.transform(cds, lambda c: F.concat(c["start"].cast("string"), F.lit("-"), c["end"].cast("string"))), ",")
    return F.concat_ws("|", strand, blocks, seq)


def write_bucketed(rows: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Writes transcripts as a table with column ``structure``, in ``buckets`` by it, and returns it.

    Operations on two tables of equally many buckets read bucket by bucket.  ``path`` is where the files go, else the warehouse.
    """
    keyed = rows.withColumn("structure", structure_key()).repartition(buckets, "structure")
    writer = keyed.write.bucketBy(buckets, "structure").sortBy("structure")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return rows.sparkSession.table(table)


def intersection_bucketed(a: DataFrame, b: DataFrame) -> DataFrame:
    """``intersection`` of two tables of ``write_bucketed``."""
    return a.join(b.select("structure"), "structure", "left_semi")


def difference_bucketed(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("structure"), "structure", "left_anti")


def union_bucketed(a: DataFrame, b: DataFrame, order: str = "tx") -> DataFrame:
    """Transcripts of both, each structure once: the first of ``a`` by ``order``, else of ``b``."""
    first = lambda rows: rows.groupBy("structure").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "structure")), order).alias("t"))
    x, y = first(a), first(b).withColumnRenamed("t", "u")
    both = x.join(y, "structure", "full")
    return both.select("structure", F.coalesce("t", "u").alias("t")).select("structure", "t.*").select(*a.columns)
