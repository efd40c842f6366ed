"""A FASTA scan that splits within a record: lines are read as Spark's text source splits them, and no row ever holds a contig.

1. Tasks join the lines of a split to pieces of letters.  A piece knows its split, the number of headers before it in the split
   (its part) and its first letter's place in that part; the part before a split's first header goes on with an earlier record.
2. Splits are few.  Running sums over those of a file give the number of headers before each, which names the record, and the letters
   that the record has had so far, which place the part.  Small tables only are windowed.
3. Pieces are dealt to chunks by their place.  A chunk is put together from the pieces that touch it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nucleotides import name_of
from ..operators.sequences import CHUNK, OVERLAP
from ..tables import Workspace

_PIECE = pa.schema([("file", pa.string()), ("split", pa.int64()), ("part", pa.int64()), ("header", pa.string()), ("at", pa.int64()), ("letters", pa.string())])
PIECE = "file string, split long, part long, header string, at long, letters string"
#: Letters of a piece.
PIECE_LETTERS = 16_384
_BLANKS = b" \t\n\r\x0b\x0c"


class _Splits:
    """Pieces of the lines of one task, which come in order; a split is known by its file and first byte."""

    def __init__(self, size: int):
        self.size, self.place = size, None
        self.part, self.at, self.header = 0, 0, None
        self.letters = bytearray()
        self.rows: list[tuple] = []

    def _piece(self, end: bool) -> None:
        """Hands on full pieces, and what is left at the end of a part; a header makes a piece even without letters."""
        while len(self.letters) >= self.size or (end and (self.letters or self.header is not None)):
            own = bytes(self.letters[: self.size])
            del self.letters[: self.size]
            self.rows.append((*self.place, self.part, self.header, self.at, own.decode()))
            self.at += len(own)
            self.header = None

    def add(self, file: str, split: int, lines: list[bytes]) -> None:
        if (file, split) != self.place:
            self.close()
            self.place, self.part, self.at, self.header = (file, split), 0, 0, None
        heads = [k for k, x in enumerate(lines) if x[:1] == b">"]
        for begin, stop in zip([0, *(h + 1 for h in heads)], [*heads, len(lines)]):
            self.letters += b"".join(lines[begin:stop]).translate(None, _BLANKS)
            self._piece(False)
            if stop < len(lines):
                self._piece(True)
                self.part, self.at, self.header = self.part + 1, 0, lines[stop][1:].rstrip(b"\r").decode()

    def close(self) -> None:
        if self.place:
            self._piece(True)

    def taken(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[k : k + 64]), _PIECE)], schema=_PIECE)


def _pieces(size: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = _Splits(size)
        for batch in batches:
            places = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            bounds = [0, *(k for k in range(1, len(places)) if places[k] != places[k - 1]), len(places)]
            lines = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b > a:
                    splits.add(*places[a], lines[a:b])
            yield from splits.taken()
        splits.close()
        yield from splits.taken()

    return pieces


@dataclass
class FastaScan:
    """``index``: (name, seq_ord, length, file) of every record.  ``chunks``: (seq, seq_ord, chunk_no, chunk), a chunk table of the
    letters (see ``operators.sequences``)."""

    index: DataFrame
    chunks: DataFrame


def _placed_parts(parts: DataFrame) -> DataFrame:
    """(file, split, part, record, before, n): the record that each part belongs to, by its place in the file from 1, and the
    letters that the record had before."""
    ends = F.max_by("n", "part")
    splits = parts.groupBy("file", "split").agg(F.max("part").alias("heads"), F.sum("n").alias("all"), F.when(F.max("part") > 0, ends).alias("last"))
    order = Window.partitionBy("file").orderBy("split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"first": F.coalesce(F.sum("heads").over(earlier), F.lit(0)), "letters": F.coalesce(F.sum("all").over(earlier), F.lit(0))})
    # Where the last record of a split begins, counted in letters of the file; it only grows.
    splits = splits.withColumn("begun", F.col("letters") + F.col("all") - F.col("last"))
    splits = splits.withColumn("open", F.col("letters") - F.coalesce(F.max("begun").over(earlier), F.lit(0)))
    rows = parts.join(splits.select("file", "split", "first", "open"), ["file", "split"])
    return rows.select("file", "split", "part", (F.col("first") + F.col("part")).alias("record"), F.when(F.col("part") == 0, F.col("open")).otherwise(0).cast("long").alias("before"), "n")


def scan_fasta(
    spark: SparkSession, path: str | list[str], include: list[str] | None = None, exclude: list[str] | None = None, split_name: bool = True, size: int = CHUNK
) -> FastaScan:
    """Index and chunks of FASTA files of any size; gzip is read as it is, by one task a file.

    Names are cut at the first blank; ``exclude`` wins over ``include``.  Carriage returns and white space in the body go, records
    without body have length 0 and no chunks.  seq_ord follows the paths of the files, then the records in them.  Letters before a
    file's first header belong to no record and are left out.  A line is a row, so a record in one line is not split.

    The pieces of letters are written to the shared folder once, for both results read them.
    """
    space = Workspace(spark, "fasta")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    pieces = space.keep(lines.mapInArrow(_pieces(PIECE_LETTERS), PIECE))
    parts = pieces.groupBy("file", "split", "part").agg(F.sum(F.length("letters")).alias("n"), F.max("header").alias("header"))
    placed = _placed_parts(parts.drop("header"))
    heads = parts.where("header IS NOT NULL").select("file", "split", "part", "header")
    records = placed.groupBy("file", "record").agg(F.sum("n").cast("long").alias("length")).where("record > 0")
    names = heads.join(placed, ["file", "split", "part"]).select("file", "record", (name_of(F.col("header")) if split_name else F.col("header")).alias("name"))
    files = records.groupBy("file").agg(F.max("record").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    index = names.join(records, ["file", "record"]).join(files, "file").select("name", (F.col("earlier") + F.col("record") - 1).cast("long").alias("seq_ord"), "length", "file", "record")
    if include is not None:
        index = index.where(F.col("name").isin(include))
    index = index.where(~F.col("name").isin(exclude)) if exclude is not None else index
    index = space.keep(index)

    # The parts are few beside the letters; the letters meet their place by (file, split, part).
    where = placed.join(index.select("file", "record", "name", "seq_ord"), ["file", "record"]).select("file", "split", "part", "name", "seq_ord", "before")
    found = pieces.where("letters <> ''").select("file", "split", "part", "at", "letters").join(where, ["file", "split", "part"])
    found = found.select("name", "seq_ord", (F.col("before") + F.col("at")).alias("begin"), "letters")
    stop = F.col("begin") + F.length("letters")
    first = F.floor(F.greatest(F.col("begin") - OVERLAP, F.lit(0)) / size)
    touched = found.withColumn("chunk_no", F.explode(F.sequence(first, F.floor((stop - 1) / size))))
    low = F.greatest(F.col("begin"), F.col("chunk_no") * size)
    high = F.least(stop, (F.col("chunk_no") + 1) * size + OVERLAP)
    own = touched.where(high > low).select(F.col("name").alias("seq"), "seq_ord", "chunk_no", F.struct(low.alias("from"), F.substring("letters", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias("letters")).alias("p"))
    chunks = own.groupBy("seq", "seq_ord", "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["letters"]), "").alias("chunk"))
    return FastaScan(index.drop("record"), chunks)


def write_scan(scan: FastaScan, path: str) -> None:
    """Index and chunks on disk: ``path``/index, and ``path``/chunks in order, so that a lookup reads few row groups."""
    scan.index.repartitionByRange("seq_ord").sortWithinPartitions("seq_ord").write.parquet(f"{path}/index")
    scan.chunks.repartitionByRange("seq", "chunk_no").sortWithinPartitions("seq", "chunk_no").write.parquet(f"{path}/chunks")


def open_scan(spark: SparkSession, path: str) -> FastaScan:
    return FastaScan(spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/chunks"))
