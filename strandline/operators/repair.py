"""Repair of chunk borders with a second prediction around them.

A second prediction changes half a chunk on both sides of its border and no more, so borders do not touch each other's letters and
each is merged by itself, by a join of the two half chunks with it.  Where it does not fit, the gene across the border is cleared:
the run of other than intergenic labels around the border, wherever that begins and ends.  Runs are found by windows over one
small row a chunk, and clearing one never changes another, so the order of borders does not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Workspace
from .labels import mismatches

#: Tags of the strand that asked for a second prediction.
PLUS_ONLY, MINUS_ONLY, BOTH = 0, 1, 2


def repair_windows(chunks: DataFrame, size: int, exon_at_boundary: int | None = None) -> DataFrame:
    """(seq, boundary, asked, window_start, window_end): half a chunk on both sides of each bad border of either strand."""
    found = mismatches(chunks, exon_at_boundary)
    asked = found.groupBy("seq", "boundary").agg(F.bool_or(F.col("strand") == "+").alias("fwd"), F.bool_or(F.col("strand") == "-").alias("rev"))
    tag = F.when(F.col("fwd") & F.col("rev"), BOTH).when(F.col("fwd"), PLUS_ONLY).otherwise(MINUS_ONLY)
    middle, half = (F.col("boundary") + 1) * size, size // 2
    return asked.select("seq", "boundary", tag.alias("asked"), (middle - half).alias("window_start"), (middle + half).alias("window_end"))


CHUNK = ["seq", "strand", "chunk_no"]


def _nth_agreeing(a: Column, b: Column, last: bool) -> Column:
    """Place (from 1) of the first or last equal elements of two arrays of one length; 0 if there is none."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    if not last:
        return F.array_position(same, True).cast("int")
    back = F.array_position(F.reverse(same), True).cast("int")
    return F.when(back == 0, 0).otherwise(F.size(same) - back + 1)


def border_merges(chunks: DataFrame, repredicted: DataFrame, size: int) -> DataFrame:
    """(seq, strand, boundary, fits, left, right): the half chunks at each border after the merge.

    The second prediction goes between the outermost places where it agrees with the left and with the right chunk; it does not
    fit where it agrees with one of them nowhere.
    """
    half = size // 2
    wanted = repredicted.where(F.col("asked") != F.when(F.col("strand") == "+", MINUS_ONLY).otherwise(PLUS_ONLY))
    wanted = wanted.select("seq", "strand", F.col("boundary").cast("long").alias("boundary"), F.col("states").alias("center"))
    here = chunks.select("seq", "strand", F.col("chunk_no").cast("long").alias("boundary"), F.slice("states", F.greatest(F.size("states") - half + 1, F.lit(1)), F.lit(half)).alias("left"))
    after = chunks.select("seq", "strand", (F.col("chunk_no").cast("long") - 1).alias("boundary"), F.slice("states", 1, half).alias("right"))
    rows = wanted.join(here, ["seq", "strand", "boundary"]).join(after, ["seq", "strand", "boundary"])
    n = F.size("right")  # the last chunk of a sequence may be shorter than half a window
    rows = rows.withColumns({"_p": _nth_agreeing(F.col("left"), F.slice("center", 1, half), False), "_q": _nth_agreeing(F.col("right"), F.slice("center", F.lit(half + 1), n), True)})
    p, q = F.col("_p"), F.col("_q")
    left = F.concat(F.slice("left", F.lit(1), p), F.slice("center", p + 1, half - p))
    right = F.concat(F.slice("center", F.lit(half + 1), F.greatest(q - 1, F.lit(0))), F.slice("right", F.greatest(q, F.lit(1)), n - q + 1))
    fits = (p > 0) & (q > 0)
    return rows.select("seq", "strand", "boundary", fits.alias("fits"), F.when(fits, left).otherwise(F.col("left")).alias("left"), F.when(fits, right).otherwise(F.col("right")).alias("right"))


def _with_halves(chunks: DataFrame, merges: DataFrame, size: int) -> DataFrame:
    """Chunks with the halves that merges give them."""
    half = size // 2
    sides = F.array(*(F.struct((F.col("boundary") + k).alias("chunk_no"), F.lit(k).alias("k"), F.col(c).alias("part")) for k, c in ((0, "left"), (1, "right"))))
    parts = merges.where("fits").select("seq", "strand", F.inline(sides))
    parts = parts.groupBy(*CHUNK).agg(F.max(F.when(F.col("k") == 1, F.col("part"))).alias("_head"), F.max(F.when(F.col("k") == 0, F.col("part"))).alias("_tail"))
    n = F.size("states")
    head, tail = F.least(n, F.lit(half)), F.least(F.greatest(n - half, F.lit(0)), F.lit(half))
    whole = F.concat(F.coalesce("_head", F.slice("states", F.lit(1), head)), F.slice("states", head + 1, n - head - tail), F.coalesce("_tail", F.slice("states", n - tail + 1, tail)))
    return chunks.join(parts, CHUNK, "left").select(*CHUNK, F.when(F.col("_head").isNull() & F.col("_tail").isNull(), F.col("states")).otherwise(whole).alias("states"))


def cleared(chunks: DataFrame, borders: DataFrame, size: int) -> DataFrame:
    """Chunks with the genes across ``borders(seq, strand, boundary)`` cleared: the run of labels other than 0 around each."""
    rows = chunks.select("seq", "strand", F.col("chunk_no").cast("long").alias("chunk_no"), "states")
    begin, n = F.col("chunk_no") * size, F.size("states")
    first, back = F.array_position("states", 0), F.array_position(F.reverse("states"), 0)  # from 1, 0 if there is none
    seen = rows.select(*CHUNK, (begin + n).alias("_stop"), F.when(first > 0, begin + first - 1).alias("_first"), F.when(back > 0, begin + n - back).alias("_last"))
    order = Window.partitionBy("seq", "strand").orderBy("chunk_no")
    around = seen.select(
        "seq", "strand", F.col("chunk_no").alias("boundary"),
        F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"),
        F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        F.max("_stop").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"),
    )
    gone = around.join(borders.select("seq", "strand", F.col("boundary").cast("long").alias("boundary")).distinct(), ["seq", "strand", "boundary"])
    gone = gone.select("seq", "strand", F.coalesce("_before", F.lit(0).cast("long")).alias("low"), F.coalesce("_after", "_end").alias("high")).where("high > low").distinct()
    touched = gone.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor((F.col("high") - 1) / size))))
    # A chunk is touched by two such runs at most, or wholly within itself by one for each border, of which it has two.
    touched = touched.groupBy(*CHUNK).agg(F.collect_set(F.struct("low", "high")).alias("_gone"))
    joined = rows.join(touched, CHUNK, "left")

    def label(x: Column, i: Column) -> Column:
        at = F.col("chunk_no") * size + i
        return F.when(F.exists("_gone", lambda g: (at >= g["low"]) & (at < g["high"])), 0).otherwise(x).cast("int")

    return joined.select(*CHUNK, F.when(F.col("_gone").isNull(), F.col("states")).otherwise(F.transform("states", label)).alias("states"))


def _differing(chunks: DataFrame, repredicted: DataFrame, size: int, windows: DataFrame | None) -> DataFrame:
    """(seq, strand, boundary, asked) of second predictions other than the labels that are there, by two 64-bit hashes of each half."""
    half = size // 2
    hashed = lambda states: F.struct(*(F.xxhash64(F.lit(k), F.size(states), states.cast("array<int>")).alias(f"h{k}") for k in (1, 2)))
    states = F.col("states")
    new = repredicted.select("seq", "strand", F.col("boundary").cast("long").alias("boundary"), *(["asked"] if windows is None else []), hashed(F.slice(states, 1, half)).alias("_p"), hashed(F.slice(states, half + 1, half)).alias("_q"))
    if windows is not None:
        new = new.join(windows.select("seq", "boundary", "asked"), ["seq", "boundary"])
    new = new.where(F.col("asked") != F.when(F.col("strand") == "+", MINUS_ONLY).otherwise(PLUS_ONLY))
    number = F.col("chunk_no").cast("long")
    sides = F.array(F.struct(number.alias("boundary"), hashed(F.slice(states, F.greatest(F.size(states) - half + 1, F.lit(1)), F.lit(half))).alias("_l"), F.lit(None).alias("_r")), F.struct((number - 1).alias("boundary"), F.lit(None).alias("_l"), hashed(F.slice(states, 1, half)).alias("_r")))
    old = chunks.select("seq", "strand", F.inline(sides)).groupBy("seq", "strand", "boundary").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return new.join(old, ["seq", "strand", "boundary"]).where("_l IS NOT NULL AND _r IS NOT NULL AND NOT (_p = _l AND _q = _r)").select("seq", "strand", "boundary", "asked")


def repaired(chunks: DataFrame, repredicted: DataFrame, size: int, windows: DataFrame | None = None) -> DataFrame:
    """Chunks after the repair.  ``repredicted(seq, strand, boundary, asked, states)``; states of a strand that a border did not
    ask for are left aside.  ``asked`` is that of ``windows`` if those are given.

    Where the second prediction does not fit, the gene across the border is cleared, after all borders have been merged.  All
    chunks but a sequence's last have ``size`` labels, and a border is asked for once on a strand.  A second prediction that is what
    the chunks have fits and changes nothing, so only the others travel.
    """
    space = Workspace(chunks.sparkSession, "repair")
    rows = chunks.select("seq", "strand", F.col("chunk_no").cast("long").alias("chunk_no"), "states")
    differing = space.keep(_differing(rows, repredicted, size, windows))
    changed = repredicted.select("seq", "strand", F.col("boundary").cast("long").alias("boundary"), "states")
    changed = space.keep(changed.join(differing, ["seq", "strand", "boundary"]))
    merges = space.keep(border_merges(rows, changed, size))
    return cleared(_with_halves(rows, merges, size), merges.where("NOT fits"), size)
