"""Equal-width histograms for each class, and the figures derived from comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: str, bins: int, by: str = "class_code") -> DataFrame:
    """(by, bin, lo, hi, n) with every bin of every class that occurs.

    Edges divide the range of all values evenly, rounded half to even if all values are whole numbers.  Bins are closed on the
    left, the last on both sides; if all values are equal they lie in the last.  Null values are left out.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"))
    span = rows.agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.bool_and(F.col("_v") == F.floor("_v")).alias("whole"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("low") + i * (F.col("high") - F.col("low")) / bins)
    spans = span.where("low IS NOT NULL").select(F.when(F.col("whole"), F.transform(raw, lambda e: F.bround(e))).otherwise(raw).alias("edges"))
    placed = rows.crossJoin(F.broadcast(spans))  # one row of edges
    at = F.least(F.greatest(F.size(F.filter("edges", lambda e: e <= F.col("_v"))) - 1, F.lit(0)), F.lit(bins - 1))
    counts = placed.groupBy("_by", at.alias("bin")).agg(F.count("*").alias("n"))
    every = counts.select("_by").distinct().crossJoin(F.broadcast(spans)).select("_by", "edges", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = every.join(counts, ["_by", "bin"], "left")
    return filled.select(F.col("_by").alias(by), F.col("bin").cast("long").alias("bin"), F.get("edges", F.col("bin")).alias("lo"), F.get("edges", F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histograms(rows: DataFrame, values: list[str], bins: int, by: str = "class_code") -> DataFrame:
    """Histograms of several columns under ``column``."""
    return reduce(DataFrame.unionByName, (histogram(rows, v, bins, by).withColumn("column", F.lit(v)) for v in values))


def f1(sensitivity: Column, precision: Column) -> Column:
    """Harmonic mean, 0 if either is 0."""
    return F.when((sensitivity == 0) | (precision == 0), 0.0).otherwise(2 * sensitivity * precision / (sensitivity + precision))


def metric_bounds(metrics: DataFrame, by: tuple[str, ...] = ("level",)) -> DataFrame:
    """Least and greatest sensitivity and precision over the compared annotations."""
    return metrics.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in ("sensitivity", "precision") for n, f in (("min", F.min), ("max", F.max))))


def f1_curve(spark, level: float, points: int = 100) -> DataFrame:
    """(precision, recall) of equal F1, where both lie in 0..1."""
    p = F.lit(level / 2) + F.col("id") * ((1 - level / 2) / (points - 1))
    rows = spark.range(points).select(p.alias("precision")).where(F.col("precision") * 2 > level)
    return rows.withColumn("recall", level * F.col("precision") / (2 * F.col("precision") - level)).where("recall BETWEEN 0 AND 1")


def f1_curves(metrics: DataFrame, by: tuple[str, ...] = ("level",), points: int = 100) -> DataFrame:
    """``f1_curve`` through the F1 of each row of ``metrics(by, f1)``; an F1 of 0 or none has no curve."""
    rows = metrics.where("f1 > 0").select(*by, "f1", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"))
    half = F.col("f1") / 2
    rows = rows.withColumn("precision", half + F.col("_k") * ((1 - half) / (points - 1))).where(F.col("precision") * 2 > F.col("f1"))
    return rows.withColumn("recall", F.col("f1") * F.col("precision") / (2 * F.col("precision") - F.col("f1"))).where("recall BETWEEN 0 AND 1").drop("_k")
