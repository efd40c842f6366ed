"""Operators on sequence rows (name, seq_ord, sequence)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nucleotides import chunk_array, composition, is_repeat_masked, rounded_up


def index(sequences: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, min_size: int | None = None) -> DataFrame:
    """(name, seq_ord, length) of the wanted sequences; ``exclude`` wins.  Order rows by length and seq_ord as needed."""
    rows = sequences.select("name", "seq_ord", F.length("sequence").cast("long").alias("length"))
    if include is not None:
        rows = rows.where(F.col("name").isin(include))
    if exclude is not None:
        rows = rows.where(~F.col("name").isin(exclude))
    return rows.where(F.col("length") >= min_size) if min_size is not None else rows


def by_length(contigs: DataFrame, descending: bool = True) -> DataFrame:
    return contigs.orderBy(F.col("length").desc() if descending else F.col("length").asc(), "seq_ord")


def slice_rows(sequences: DataFrame, begin: int, stop: int) -> DataFrame:
    """Sequences by place, as a list slice."""
    return sequences.where((F.col("seq_ord") >= begin) & (F.col("seq_ord") < stop))


def by_name(sequences: DataFrame, name: str) -> DataFrame:
    """The first sequence of that name."""
    return sequences.where(F.col("name") == name).orderBy("seq_ord").limit(1)


def chunks(sequences: DataFrame, size: int, drop_remainder: bool = False) -> DataFrame:
    """(name, chunk_no, chunk)."""
    return sequences.select("name", F.posexplode(chunk_array(F.col("sequence"), size, drop_remainder)).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


def evidence_chunks(sequences: DataFrame, size: int) -> DataFrame:
    """(name, chunk_no, evidence) of the per-base array ``evidence``, whose length must be that of the sequence."""
    fits = F.when(F.size("evidence") == F.length("sequence"), F.col("evidence")).otherwise(F.raise_error(F.lit("evidence has another length than its sequence")).cast("array<double>"))
    rows = sequences.where("evidence IS NOT NULL").select("name", fits.alias("evidence"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("evidence") / size).cast("int") - 1, F.lit(0))), lambda i: F.slice("evidence", i * size + 1, F.lit(size)))
    return rows.select("name", F.posexplode(parts).alias("chunk_no", "evidence"))


#: Letters of the chunks that sequences are looked up in; each chunk also has the ``OVERLAP`` letters after it.
CHUNK, OVERLAP = 16_384, 2


def lengths(sequences: DataFrame) -> DataFrame:
    """(seq, length): joins that need no letters go to this."""
    return sequences.select(F.col("name").alias("seq"), F.length("sequence").cast("long").alias("length"))


def chunk_table(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """(seq, chunk_no, chunk): pieces of ``size`` letters with ``OVERLAP`` more, the table that letters are looked up in."""
    parts = F.transform(F.array(F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))), lambda xs: F.transform(xs, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(xs, i + 1), 1, OVERLAP), F.lit("")))))
    rows = sequences.select(F.col("name").alias("seq"), F.posexplode(F.get(parts, F.lit(0))).alias("chunk_no", "chunk"))
    return rows.withColumn("chunk_no", F.col("chunk_no").cast("long"))


def write_chunks(sequences: DataFrame, path: str, size: int = CHUNK) -> None:
    """An index of the sequences on disk: their chunks in order, so that a lookup reads few row groups."""
    chunk_table(sequences, size).repartitionByRange("seq", "chunk_no").sortWithinPartitions("seq", "chunk_no").write.parquet(path)


def lengths_of_chunks(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(seq, length) from a chunk table."""
    return chunks.groupBy("seq").agg(F.max(F.col("chunk_no") * size + F.least(F.length("chunk"), F.lit(size))).cast("long").alias("length"))


def with_letters(ranges: DataFrame, chunks: DataFrame, start: str = "start", end: str = "end", size: int = CHUNK) -> DataFrame:
    """Rows of ``ranges(seq, start, end, ...)``, one for each chunk that a range touches, with ``from`` (first position) and
    ``letters`` of that part, from a ``chunk_table``.  What lies beyond the sequence has no letters; unknown sequences give empty ones.

    A range meets only the chunks it touches, so no row carries a whole sequence, and a long one is as many keys as chunks.
    """
    first = F.floor(F.greatest(F.col(start), F.lit(0)) / size)
    last = F.greatest(first, F.floor((F.col(end) - 1) / size))
    # A range no longer than the overlap lies in the chunk it begins in.
    last = F.when(F.col(end) - F.col(start) <= OVERLAP, first).otherwise(last)
    asked = ranges.withColumn("_chunk", F.explode(F.sequence(first, last)))
    found = asked.join(chunks.select("seq", F.col("chunk_no").alias("_chunk"), "chunk"), ["seq", "_chunk"], "left")
    begin = F.greatest(F.col(start), F.col("_chunk") * size)
    stop = F.when(F.col(end) - F.col(start) <= OVERLAP, F.col(end)).otherwise(F.least(F.col(end), (F.col("_chunk") + 1) * size))
    letters = F.substring("chunk", (begin - F.col("_chunk") * size + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))
    return found.select(*ranges.columns, begin.alias("from"), F.coalesce(letters, F.lit("")).alias("letters"))


def put_together(parts: Column) -> Column:
    """The letters of an array of (from, letters) in order."""
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p["letters"]), "")


def fetch(sequences: DataFrame, ranges: DataFrame, size: int = CHUNK) -> DataFrame:
    """(fetch_id, name, sequence) for ``ranges(fetch_id, seq, part, start, end)``: parts put together in order.

    The name tells sequence and one-based ranges.  A range outside of its sequence fails the query; unknown names give no row.
    """
    return _fetch(chunk_table(sequences, size), lengths(sequences), ranges, size)


def fetch_indexed(chunks: DataFrame, ranges: DataFrame, size: int = CHUNK) -> DataFrame:
    """``fetch`` from a chunk table, such as one that ``write_chunks`` wrote."""
    return _fetch(chunks, lengths_of_chunks(chunks, size), ranges, size)


def checked_ranges(ranges: DataFrame, known_lengths: DataFrame) -> DataFrame:
    """(fetch_id, seq, part, start, end) of known sequences; a range outside of its sequence fails the query."""
    inside = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("length"))
    known = ranges.select("fetch_id", "seq", "part", "start", "end").join(known_lengths, "seq")
    return known.withColumn("end", F.when(inside, F.col("end")).otherwise(F.raise_error(F.lit("range outside of the sequence")).cast("long"))).drop("length")


def assembled(pieces: DataFrame) -> DataFrame:
    """(fetch_id, name, sequence) of ranges with ``from`` and ``letters``, as lookups give them."""
    grouped = pieces.groupBy("fetch_id", "seq").agg(F.sort_array(F.collect_list(F.struct("part", "from", "start", "end", "letters"))).alias("ps"))
    heads = F.filter("ps", lambda p: p["from"] == p["start"])
    label = F.array_join(F.transform(heads, lambda p: F.concat((p["start"] + 1).cast("string"), F.lit("-"), p["end"].cast("string"))), ",")
    return grouped.select("fetch_id", F.concat("seq", F.lit(":"), label).alias("name"), F.array_join(F.transform("ps", lambda p: p["letters"]), "").alias("sequence"))


def _fetch(chunks: DataFrame, known_lengths: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    return assembled(with_letters(checked_ranges(ranges, known_lengths), chunks, size=size))


def base_shares(sequences: DataFrame, separate_repeats: bool = False) -> DataFrame:
    """Each sequence's base composition as shares; null for an empty one."""
    counts = composition(F.col("sequence"), separate_repeats)
    size = F.length("sequence")
    return sequences.select("name", *(F.when(size > 0, n / size).alias(_share(c)) for c, n in counts.items()))


def genome_shares(sequences: DataFrame, separate_repeats: bool = False) -> DataFrame:
    """One row: shares over all sequences, weighted by their size."""
    counts = composition(F.col("sequence"), separate_repeats)
    return sequences.agg(*(((F.sum(n) / F.sum(F.length("sequence"))).alias(_share(c))) for c, n in counts.items()))


def _share(letter: str) -> str:
    return f"share_{letter.lower()}_masked" if letter.islower() else f"share_{letter.lower()}"


def any_masked(sequences: DataFrame) -> DataFrame:
    return sequences.agg(F.coalesce(F.bool_or(is_repeat_masked(F.col("sequence"))), F.lit(False)).alias("is_repeat_masked"))


def joined(left: DataFrame, right: DataFrame, on: str = "seq_ord") -> DataFrame:
    """Pairs of sequences put together under the name of the left one."""
    r = right.select(on, F.col("sequence").alias("_more"))
    return left.join(r, on).withColumn("sequence", F.concat("sequence", "_more")).drop("_more")


def renamed(sequences: DataFrame, name: str | Column) -> DataFrame:
    """All names replaced by a constant or by an expression over the row."""
    return sequences.withColumn("name", F.lit(name) if isinstance(name, str) else name)


def totals(sequences: DataFrame, size: int) -> DataFrame:
    """One row: n_sequences, nucleotides, n_chunks."""
    length = F.length("sequence")
    return sequences.agg(F.count("*").alias("n_sequences"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("nucleotides"), F.coalesce(F.sum(F.ceil(length / size)), F.lit(0)).cast("long").alias("n_chunks"))


#: Contigs that are numbered at once among those of their length.
NUMBERED = 100_000


def grouped(contigs: DataFrame, chunk_size: int, delta: float = 0.1, factors: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """(name, length, group_id, chunk_size): contigs by falling length, put into groups that share a chunk size.

    A group takes contigs while they are at least ``delta`` of its chunk size long, or that size cannot shrink; beyond
    ``limit`` padded nucleotides it closes after the contig that passed it.  A much shorter contig sets a new chunk size, its
    own length (rounded up to ``factors``, an empty one counting as 1), unless that would not be smaller; then it joins its group
    and closes it.

    Each decision depends on the last, but contigs of one length only on how many there are: the fold sees a row for each
    length, and the places of contigs within their length are counted in Spark.
    """
    least = 1 if factors is None else rounded_up(1, factors)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        size, group, used, members = chunk_size, 0, 0, 0
        out = []
        for n, count in rows.sort_values("length", ascending=False)[["length", "n"]].itertuples(index=False):
            fits = n >= delta * size or size <= least
            smaller = max(n, 1) if factors is None else rounded_up(max(n, 1), factors)
            if not fits and smaller < size:
                size, group, used, members, fits = smaller, group + (members > 0), 0, 0, True
            padded = -(-n // size) * size
            # Contigs until the open group closes, and until later ones do.
            if not fits:
                room, each = 1, 1
            elif limit is None or not padded:
                room = each = count + 1
            else:
                room, each = (limit - used) // padded + 1, limit // padded + 1
            out.append((n, size, group, room, each))
            left = count - room
            if left < 0:
                used, members = used + count * padded, members + count
            else:
                group, members = group + 1 + left // each, left % each
                used = members * padded
        return pd.DataFrame(out, columns=["length", "chunk_size", "first", "room", "each"])

    lengths = contigs.groupBy("length").agg(F.count("*").alias("n"))
    folded = lengths.groupBy().applyInPandas(fold, "length long, chunk_size long, first long, room long, each long")
    part = F.floor(F.col("seq_ord") / NUMBERED)
    before = contigs.groupBy("length", part.alias("_part")).agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = contigs.select("name", "seq_ord", "length", part.alias("_part")).join(before.select("length", "_part", "_before"), ["length", "_part"])
    rows = rows.withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_part").orderBy("seq_ord")) - 1)
    later = F.col("first") + 1 + F.floor((F.col("_k") - F.col("room")) / F.col("each"))
    group = F.when(F.col("_k") < F.col("room"), F.col("first")).otherwise(later).cast("long")
    return rows.join(folded, "length").select("name", "length", group.alias("group_id"), "chunk_size")
