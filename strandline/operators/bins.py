"""A hierarchical bin index for range lookups in written tables.

A row belongs to the smallest bin that holds it: bins of 2^shift positions, of eight times as many, and so on up to one bin of a
whole sequence.  Bins of all levels are numbered in one row, from the whole sequence's (0) down, so the bins that a range can
touch are one stretch of numbers on each level.  In a table in order of sequence and bin those stretches are few row groups, and
the plain comparisons that ask for them are pushed down to the scan, which passes over the others.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of the smallest bins as a power of two, and the number of levels under the whole sequence.
SHIFT, DEPTH = 14, 5
#: Bytes of a row group of a written table, before compression: so large is the least that a lookup reads of each stretch.
ROW_GROUP = 1 << 20


def _first(level: int) -> int:
    """Number of the first bin of a level; level 0 is the whole sequence."""
    return (8**level - 1) // 7


def bin_of(low: Column, high: Column, shift: int = SHIFT, depth: int = DEPTH) -> Column:
    """Number of the smallest bin that holds a half-open range; beyond the last bins, and for empty or negative ranges, 0."""
    last = F.greatest(high - 1, low)

    def here(level: int) -> Column:
        s = shift + 3 * (depth - level)
        a, b = (F.call_function("shiftright", x.cast("long"), F.lit(s)) for x in (low, last))
        return F.when((a == b) & (a >= 0) & (a < 8**level), a + _first(level))

    return F.coalesce(*(here(level) for level in range(depth, 0, -1)), F.lit(0)).cast("int")


def stretches(low: int, high: int, shift: int = SHIFT, depth: int = DEPTH) -> list[tuple[int, int]]:
    """First and last number of the bins on each level that rows which overlap a half-open range can be in."""
    out = [(0, 0)]
    if high <= low or high <= 0:
        return out
    for level in range(1, depth + 1):
        s, most = shift + 3 * (depth - level), 8**level - 1
        a, b = max(low, 0) >> s, (high - 1) >> s
        if a <= most:
            out.append((_first(level) + a, _first(level) + min(b, most)))
    return out


def write_binned(rows: DataFrame, path: str, shift: int = SHIFT, depth: int = DEPTH, low: str = "tx_start", high: str = "tx_end", row_group: int = ROW_GROUP) -> None:
    """Rows with their bin, in order of sequence, bin and start."""
    binned = rows.withColumn("bin", bin_of(F.col(low), F.col(high), shift, depth))
    ordered = binned.repartitionByRange("seq", "bin", low).sortWithinPartitions("seq", "bin", low)
    ordered.write.option("parquet.block.size", row_group).parquet(path)


def overlapping_binned(table: DataFrame, seq: str, low: int, high: int, shift: int = SHIFT, depth: int = DEPTH, start: str = "tx_start", end: str = "tx_end") -> DataFrame:
    """Rows of a binned table that overlap a half-open range; ``shift`` and ``depth`` are those it was written with."""
    bins = reduce(or_, (F.col("bin").between(a, b) if a < b else F.col("bin") == a for a, b in stretches(low, high, shift, depth)))
    return table.where((F.col("seq") == seq) & bins & (F.col(start) < high) & (F.col(end) > low))
