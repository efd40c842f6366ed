"""Joins of positions and ranges with the blocks of transcripts.

Spark has no interval join, so intervals are dealt to bins of a fixed width: a point lies in one bin and meets the intervals of
that bin by an equi-join, with the exact test as residual.  A long sequence is thereby split into as many keys as it has bins.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CDS, INTERGENIC, INTRON
from .transcripts import end, exploded, non_empty, start

BIN = 1024
#: How much wider the bins of each of the levels 1 and 2 are.
FAN = 256
#: Width of bins in which intervals of a chromosome are put in order.
WIDE = 65_536
#: The largest pieces that spans are cut into have 4^TOP positions.
TOP = 10
#: The same for ranges that are cut at edges: 4^15 positions, so a range of a whole chromosome is fewer than 100 pieces.
RANGE_TOP = 15


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor((high - 1) / width)))


def point_interval_join(points: DataFrame, intervals: DataFrame, pos: str, low: str, high: str, keys: tuple[str, ...] = ("seq",), width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs with ``low <= pos < high`` and equal ``keys``; empty intervals hold nothing."""
    placed = points.withColumn("_bin", F.floor(F.col(pos) / width))
    spread = intervals.where(F.col(high) > F.col(low)).withColumn("_bin", _bins(F.col(low), F.col(high), width))
    on = reduce(and_, (placed[c] == spread[c] for c in (*keys, "_bin")))
    pairs = placed.join(spread, on & (placed[pos] >= spread[low]) & (placed[pos] < spread[high]), how)
    if how == "left_semi":
        return pairs.drop("_bin")
    return pairs.select(*points.columns, *(spread[c] for c in intervals.columns if c not in keys))


def _level(low: Column, high: Column, width: int) -> Column:
    """The level on which an interval is at most FAN + 1 bins, if there is one."""
    return F.when(high - low <= width * FAN, 0).when(high - low <= width * FAN**2, 1).otherwise(2)


def _on_levels(rows: DataFrame, low: str, high: str, top: DataFrame, width: int, own_roles: list[int], up_role: int) -> DataFrame:
    """Rows in the bins of their own level (with ``own_roles``) and of the levels above, up to ``top``, that intervals of the other side have."""
    low, high = F.col(low), F.col(high)
    bins = lambda level: F.sequence(F.floor(low / width / F.pow(F.lit(FAN), level)), F.floor((high - 1) / width / F.pow(F.lit(FAN), level)))
    cells = lambda level, role: F.transform(bins(level), lambda b: F.struct(level.cast("int").alias("_level"), b.cast("long").alias("_bin"), F.lit(role).alias("_role")))
    higher = F.when(F.col("_own") < F.col("_top"), F.sequence(F.col("_own") + 1, "_top")).otherwise(F.array().cast("array<int>"))
    own = F.concat(*(cells(F.col("_own"), role) for role in own_roles))
    placed = rows.withColumn("_own", _level(low, high, width)).crossJoin(F.broadcast(top))
    return placed.select(*rows.columns, F.inline(F.concat(own, F.flatten(F.transform(higher, lambda level: cells(level, up_role))))))


def interval_overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], keys: tuple[str, ...] = ("seq",), width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals with equal ``keys``, each once: a pair counts in the bin where its overlap begins.

    Long intervals lie in the wider bins of higher levels, so none is many rows; two intervals meet on the level of the longer one.
    Where the other side has no long intervals, short ones are rows of their own level only.
    """
    (a, b), (c, d) = left_range, right_range
    x, y = left.where(F.col(b) > F.col(a)), right.where(F.col(d) > F.col(c))
    tops = [rows.agg(F.coalesce(F.max(_level(F.col(low), F.col(high), width)), F.lit(0)).alias("_top")) for rows, low, high in ((y, c, d), (x, a, b))]
    x = _on_levels(x, a, b, tops[0], width, [0], 1)
    y = _on_levels(y, c, d, tops[1], width, [0, 1], 0)
    pairs = x.join(y, [*keys, "_level", "_bin", "_role"]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    begins = F.floor(F.greatest(F.col(a), F.col(c)) / width / F.pow(F.lit(FAN), F.col("_level")))
    return pairs.where(F.col("_bin") == begins).drop("_level", "_bin", "_role")


def overlap_semi_join(rows: DataFrame, others: DataFrame, keys: list[str], low: str = "low", high: str = "high", width: int = BIN) -> DataFrame:
    """Rows that overlap any of ``others`` with equal ``keys``, each once; empty intervals overlap nothing.

    No pairs are formed: of the others that begin before a row ends, the furthest end decides.  It is found by a running maximum
    within bins of ``width``, and over the bins.
    """
    known = reduce(and_, (F.col(c).isNotNull() for c in keys))
    starts = others.where(known & (F.col(high) > F.col(low))).groupBy(*keys, F.col(low).alias("_at")).agg(F.max(high).alias("_reach"))
    asked = rows.where(F.col(high) > F.col(low)).withColumns({"_at": F.col(high), "_reach": F.lit(None).cast(starts.schema["_reach"].dataType)})
    bin_ = F.floor(F.col("_at") / width).alias("_bin")
    tops = starts.select(*keys, bin_, "_reach").unionByName(asked.select(*keys, bin_, "_reach")).groupBy(*keys, "_bin").agg(F.max("_reach").alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_bin", F.max("_top").over(earlier).alias("_carried"))
    # At one position rows come first: what begins where a row ends does not overlap it.
    both = asked.select("*", F.lit(0).alias("_kind")).unionByName(starts.select("*", F.lit(1).alias("_kind")), allowMissingColumns=True).select("*", bin_)
    own = Window.partitionBy(*keys, "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    reached = both.withColumn("_reach", F.max("_reach").over(own)).where("_kind = 0").join(carried, [*keys, "_bin"])
    return reached.where(F.greatest("_reach", "_carried") > F.col(low)).select(*rows.columns)  # nulls do not count


def running_reach(rows: DataFrame, keys: list[str], low: str, high: str, width: int = WIDE) -> DataFrame:
    """Adds _reach, the greatest ``high`` of the rows before in order of ``low`` and ``high`` (null for the first), and _bin.

    In two levels: within bins of ``width``, and over the bins, so that no window sees all rows of a chromosome.
    """
    placed = rows.withColumn("_bin", F.floor(F.col(low) / width))
    bins = placed.groupBy(*keys, "_bin").agg(F.max(high).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", F.max("_top").over(earlier).alias("_carried"))
    own = Window.partitionBy(*keys, "_bin").orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max(high).over(own), F.col("_carried"))  # nulls do not count
    return placed.join(bins, [*keys, "_bin"]).withColumn("_reach", reach).drop("_carried")


def islands(rows: DataFrame, keys: list[str], low: str, high: str, touching: bool, width: int = WIDE) -> DataFrame:
    """Adds _island, where the union of intervals begins that a row belongs to; ``touching`` ones join or not."""
    reached = running_reach(rows, keys, low, high, width)
    apart = F.col("_reach").isNull() | ((F.col(low) > F.col("_reach")) if touching else (F.col(low) >= F.col("_reach")))
    marked = reached.withColumn("_start", F.when(apart, F.col(low)))
    bins = marked.groupBy(*keys, "_bin").agg(F.max("_start").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_bin", F.max("_last").over(earlier).alias("_carried"))
    own = Window.partitionBy(*keys, "_bin").orderBy(low, high).rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.join(bins, [*keys, "_bin"])
    return joined.withColumn("_island", F.coalesce(F.max("_start").over(own), F.col("_carried"))).drop("_reach", "_start", "_carried", "_bin")


def merged(blocks: DataFrame, keys: list[str], low: str = "low", high: str = "high", width: int = WIDE) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    return islands(blocks, keys, low, high, True, width).groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def _merged_within(blocks: DataFrame, keys: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """``merged`` for keys with few intervals each."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = blocks.withColumn("_new", F.coalesce((F.col(low) > reach).cast("int"), F.lit(1))).withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_k").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_k")


GENE = ["seq", "strand", "gene"]


def gene_spans(transcripts: DataFrame) -> DataFrame:
    """(seq, strand, gene, gene_start, low, high): where a gene has an isoform, with the gene's start."""
    rows = non_empty(transcripts).select(*GENE, start(F.col("cds")).alias("low"), end(F.col("cds")).alias("high"))
    starts = F.min("low").over(Window.partitionBy(*GENE))
    return _merged_within(rows, GENE).withColumn("gene_start", starts)


def aligned_pieces(low: Column, high: Column, top: int = TOP) -> Column:
    """Array of (level, node): an interval as few pieces of 4^level positions from node * 4^level, levels 0 to ``top``."""

    def of_level(level: Column) -> Column:
        def edges(shift: Column) -> tuple[Column, Column]:
            up = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
            return F.call_function("shiftright", low + up, shift), F.call_function("shiftright", high, shift)

        a, b = edges(2 * level)
        c, d = edges(2 * level + 2)
        whole = (level < top) & (c < d)  # what the next level has
        left_end = F.when(whole, F.least(b, 4 * c)).otherwise(b)
        right_begin = F.when(whole, F.greatest(4 * d, a)).otherwise(b)

        def run(x: Column, y: Column) -> Column:
            return F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))

        return F.transform(F.concat(run(a, left_end), run(right_begin, b)), lambda n: F.struct(level.alias("level"), n.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), of_level))


def deciding_genes(positions: DataFrame, transcripts: DataFrame, pos_id: str = "pos_id", pos: str = "pos") -> DataFrame:
    """(pos_id, seq, pos, plus, minus): the deciding gene on each strand as (gene_start, gene), null where there is none.

    Spans are cut into aligned pieces of powers of four, and of all genes over a piece only the first is kept; a position lies in
    one piece of each level.  So a position meets ``TOP`` + 1 rows at most, however many genes lie over it.
    """
    pieces = gene_spans(transcripts).where("high > low").select("seq", "strand", F.struct("gene_start", "gene").alias("first"), F.inline(aligned_pieces(F.col("low"), F.col("high"), TOP)))
    strands = [F.min(F.when(F.col("strand") == s, F.col("first"))).alias(name) for s, name in (("+", "plus"), ("-", "minus"))]
    pieces = pieces.groupBy("seq", "level", "node").agg(*strands)
    asked = positions.select(pos_id, "seq", pos, F.explode(F.sequence(F.lit(0), F.lit(TOP))).alias("level"))
    asked = asked.withColumn("node", F.call_function("shiftright", F.col(pos).cast("long"), 2 * F.col("level")))
    return asked.join(pieces, ["seq", "level", "node"], "left").groupBy(pos_id, "seq", pos).agg(F.min("plus").alias("plus"), F.min("minus").alias("minus"))


def classified_points(points: DataFrame, transcripts: DataFrame, width: int = BIN) -> DataFrame:
    """(seq, pos, fwd, rev) for distinct ``points(seq, pos)``, as ``classify_positions`` labels them."""
    keyed = points.select(F.struct("seq", "pos").alias("_id"), "seq", "pos")
    first = deciding_genes(keyed, transcripts, "_id", "pos")
    sides = F.array(*(F.struct(F.lit(s).alias("strand"), F.col(name)["gene"].alias("gene")) for s, name in (("+", "plus"), ("-", "minus"))))
    sides = first.select("_id", "seq", F.col("pos").alias("_pos"), F.inline(sides)).where("gene IS NOT NULL")
    # Only the deciding gene's blocks are looked at.
    blocks = exploded(non_empty(transcripts)).select(*GENE, F.col("cds_start").alias("low"), F.col("cds_end").alias("high"))
    coding = point_interval_join(sides, blocks, "_pos", "low", "high", tuple(GENE), width, "left_semi")
    coding = coding.groupBy("_id").agg(*(F.bool_or(F.col("strand") == s).alias(f"_{name}") for s, name in (("+", "plus"), ("-", "minus"))))
    joined = first.join(coding, "_id", "left")

    def label(name: str, out: str) -> Column:
        return F.when(F.col(f"_{name}"), CDS).when(F.col(name).isNotNull(), INTRON).otherwise(INTERGENIC).alias(out)

    return joined.select("seq", "pos", label("plus", "fwd"), label("minus", "rev"))


def classify_positions(positions: DataFrame, transcripts: DataFrame, pos_id: str = "pos_id", pos: str = "pos", width: int = BIN) -> DataFrame:
    """(pos_id, seq, pos, fwd, rev): the label of each position on both strands.

    Coding in any isoform makes a position cds for its gene, else within an isoform it is intron.  Of several genes that hold a
    position the one that starts first decides, ties by gene; without any, or without a sequence or position, it is intergenic.
    Each row of ``positions`` gives one row, repeated ones too; what is shared by them is worked out once.
    """
    points = positions.where(F.col("seq").isNotNull() & F.col(pos).isNotNull()).select("seq", F.col(pos).alias("pos")).distinct()
    labels = classified_points(points, transcripts, width).withColumnRenamed("pos", "_pos")
    rows = positions.select(pos_id, "seq", pos)
    joined = rows.join(labels.withColumnRenamed("seq", "_seq"), (rows["seq"] == F.col("_seq")) & (rows[pos] == F.col("_pos")), "left")
    return joined.select(pos_id, "seq", pos, *(F.coalesce(c, F.lit(INTERGENIC)).alias(c) for c in ("fwd", "rev")))


def classify_ranges(ranges: DataFrame, transcripts: DataFrame, width: int = BIN) -> DataFrame:
    """(range_id, seq, strand, label, seg_start, seg_end) for ``ranges(range_id, seq, range_start, range_end)``.

    A range is cut, on each strand, at every block edge inside it; a piece has the label of its first position.  Neighbours
    of one label stay apart; an empty range gives no rows.
    """
    asked = ranges.where("range_end > range_start").select("range_id", "seq", "range_start", "range_end")
    both = asked.select("*", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    edges = exploded(non_empty(transcripts)).select("seq", "strand", F.explode(F.array("cds_start", "cds_end")).alias("edge")).distinct()
    # Edges strictly inside lie in one of the aligned pieces of the range, of which there are few however long it is.
    inside = asked.where("range_end > range_start + 1").select("range_id", "seq", F.inline(aligned_pieces(F.col("range_start") + 1, F.col("range_end"), RANGE_TOP)))
    levels = F.explode(F.sequence(F.lit(0), F.lit(RANGE_TOP))).alias("level")
    placed = edges.select("seq", "strand", "edge", levels).withColumn("node", F.call_function("shiftright", F.col("edge").cast("long"), 2 * F.col("level")))
    inner = placed.join(inside, ["seq", "level", "node"])
    ends = both.select("range_id", "seq", "strand", F.explode(F.array("range_start", "range_end")).alias("edge"))
    cuts = inner.select("range_id", "seq", "strand", "edge").unionByName(ends).distinct()
    follow = Window.partitionBy("range_id", "seq", "strand").orderBy("edge")
    pieces = cuts.withColumn("seg_end", F.lead("edge").over(follow)).where("seg_end IS NOT NULL").withColumnRenamed("edge", "seg_start")
    points = pieces.select("seq", F.col("seg_start").alias("pos")).distinct()
    labels = classified_points(points, transcripts, width).withColumnRenamed("pos", "seg_start")
    return pieces.join(labels, ["seq", "seg_start"]).select("range_id", "seq", "strand", F.when(F.col("strand") == "+", F.col("fwd")).otherwise(F.col("rev")).alias("label"), "seg_start", "seg_end")


def labelled_map(pieces: DataFrame) -> DataFrame:
    """Pieces of ``classify_ranges`` as one row a range and strand: a map from label to its pieces in order."""
    by_label = pieces.groupBy("range_id", "seq", "strand", "label").agg(F.sort_array(F.collect_list(F.struct("seg_start", "seg_end"))).alias("pieces"))
    return by_label.groupBy("range_id", "seq", "strand").agg(F.map_from_entries(F.collect_list(F.struct("label", "pieces"))).alias("segments"))


def overlapping(rows: DataFrame, seq: str, low: int, high: int, start_col: str = "tx_start", end_col: str = "tx_end") -> DataFrame:
    """Rows that overlap one half-open range: plain comparisons, which reach the scan's row-group statistics."""
    return rows.where((F.col("seq") == seq) & (F.col(start_col) < high) & (F.col(end_col) > low))
