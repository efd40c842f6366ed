"""Connected components of an edge table, by alternating star contractions (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace


def connected_components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node of the component.

    Nulls never link; loops and repeated edges are harmless; no edges give no rows.  Every round halves the depth of the
    trees at least, so about log2 of the longest path rounds run, each on a written table of at most as many edges.  Whether a
    round has changed anything is seen while its table is written, so edges that are stars already take one round.
    """
    now, state = _kept(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), space
    )
    while True:
        after, new_state = _kept(_small_star(_large_star(now)), space)
        space.drop(now)
        now = after
        if new_state == state:
            break
        state = new_state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _kept(edges: DataFrame, space: Workspace) -> tuple[DataFrame, dict]:
    return space.keep_seen(edges, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least node of its neighbourhood; ``u`` > ``v`` in each edge.

    That least node is the least of its smaller neighbours, or itself if it has none.
    """
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them; a node has few after the large star."""
    tied = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
