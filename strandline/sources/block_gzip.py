"""FASTA in block gzip: gzip members of at most 64 KB, with a table of their offsets, from which ranges are read by blocks.

A target folder holds ``text`` (part files, in order by name), ``blocks`` (where each block lies, and where its text lies in all of the
text) and ``records`` (where each record's letters begin).  Every part is a block gzip file, and so are the parts one after another.
A long record goes over several parts, so it is written and read by many tasks.

The layout of the text follows from the records' lengths, so each chunk of letters knows its place before anything is written.  A
task writes its part under a name of its own; only parts that the table of blocks names count, and Spark commits that table once,
so a task that runs again leaves nothing behind that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.sequences import OVERLAP, assembled, checked_ranges, chunk_table
from ..tables import Workspace
from .fasta_scan import FastaScan, scan_fasta

#: Text of a block at most: with the most that compression can add, its size stays within 16 bits.
BLOCK = 65_280
WIDTH, LINES = 80, 200
#: Records whose places are summed at once, and neighbouring blocks that are read at once.
SUMMED, READ = 100_000, 64

_BLOCKS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("begin", pa.int64()), ("n", pa.int64())])
BLOCKS = "file string, at long, size long, begin long, n long"


def gzip_block(text: bytes) -> bytes:
    """One gzip member whose extra field BC tells its own size less one; an empty one ends a file."""
    for level in (6, 0):
        deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = deflate.compress(text) + deflate.flush()
        if len(body) + 26 <= 65_536:
            break
    head = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(text), len(text))


def _written(folder: str):
    """Rows (begin, text) of a task, which follow each other, as one part file; rows of its blocks."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.fa.gz"
        out, at, begin, text, rows = None, 0, None, bytearray(), []

        def block(n: int) -> None:
            nonlocal at, begin
            data = gzip_block(bytes(text[:n]))
            out.write(data)
            rows.append((name, at, len(data), begin, n))
            del text[:n]
            at, begin = at + len(data), begin + n

        for batch in batches:
            for place, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    out, begin = system.open_output_stream(f"{root}/{name}", compression=None), place
                if place != begin + len(text):
                    raise ValueError(f"the text has another length than its records before byte {place}")
                text += own
                while len(text) >= BLOCK:
                    block(BLOCK)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)
                rows.clear()
        if out is not None:
            if text:
                block(len(text))
            out.write(gzip_block(b""))
            out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)

    return written


def _placed(index: DataFrame, width: int) -> DataFrame:
    """(name, seq_ord, length, head, body): where a record's header and its first letter lie in the text."""
    rows = index.select("name", "seq_ord", "length", F.floor(F.col("seq_ord") / SUMMED).alias("part"))
    rows = rows.withColumn("title", F.octet_length("name") + 2).withColumn("bytes", F.col("title") + F.col("length") + F.ceil(F.col("length") / width))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("bytes").alias("all")).select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("earlier"))
    own = F.sum("bytes").over(Window.partitionBy("part").orderBy("seq_ord"))
    rows = rows.withColumn("own", own - F.col("bytes")).join(parts, "part")
    head = (F.col("earlier") + F.col("own")).cast("long")
    return rows.select("name", "seq_ord", "length", head.alias("head"), (head + F.col("title")).alias("body"), F.lit(width).cast("long").alias("width"))


def write_block_fasta(scan: FastaScan, target: str, width: int = WIDTH, size: int = WIDTH * LINES) -> None:
    """Writes records as block gzip, with the tables of blocks and records; an existing target is refused.

    ``scan`` has chunks of ``size`` letters, a multiple of ``width``, and its seq_ord is unique.  Letters are single bytes.  Records
    without letters are a header.  The target is one that all machines reach, by a URI that Arrow's file systems know.
    """
    if size % width:
        raise ValueError(f"chunks of {size} letters are not whole lines of {width}")
    spark = scan.index.sparkSession
    system, root = fs.FileSystem.from_uri(target)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(target)
    system.create_dir(f"{root}/text", recursive=True)
    _placed(scan.index, width).sort("name", "seq_ord").write.parquet(f"{target}/records")
    records = spark.read.parquet(f"{target}/records")
    heads = records.select(F.col("head").alias("begin"), F.concat(F.lit(">"), "name", F.lit("\n")).alias("text"))
    wrapped = F.regexp_replace(F.substring("chunk", 1, size), f"(.{{1,{width}}})", "$1\n")
    place = F.col("body") + F.col("chunk_no") * (size + size // width)
    bodies = scan.chunks.select("seq_ord", "chunk_no", "chunk").join(records.select("seq_ord", "body"), "seq_ord").select(place.alias("begin"), wrapped.alias("text"))
    rows = heads.unionByName(bodies).select("begin", F.encode("text", "UTF-8").alias("text"))
    rows = rows.repartitionByRange("begin").sortWithinPartitions("begin")
    rows.mapInArrow(_written(f"{target}/text"), BLOCKS).write.parquet(f"{target}/blocks")
    # What tasks left that did not come to their end, or ran twice.
    named = {r.file for r in spark.read.parquet(f"{target}/blocks").select("file").distinct().toLocalIterator()}
    for part in system.get_file_info(fs.FileSelector(f"{root}/text")):
        if part.base_name not in named:
            system.delete_file(part.path)


def compress_sequences(sequences: DataFrame, target: str, width: int = WIDTH) -> None:
    """``write_block_fasta`` of rows (name, seq_ord, sequence); a null sequence is an empty one."""
    size = width * LINES
    rows = sequences.select("name", "seq_ord", F.coalesce("sequence", F.lit("")).alias("sequence"))
    index = rows.select("name", "seq_ord", F.length("sequence").cast("long").alias("length"))
    chunks = chunk_table(rows.select(F.col("seq_ord").alias("name"), "sequence"), size).withColumnRenamed("seq", "seq_ord")
    write_block_fasta(FastaScan(index, chunks), target, width, size)


def compress_fasta(spark: SparkSession, path: str | list[str], target: str, width: int = WIDTH) -> None:
    """FASTA files, plain or gzip, as block gzip; headers are cut at the first blank."""
    mark = Workspace.mark()
    write_block_fasta(scan_fasta(spark, path, size=width * LINES), target, width, width * LINES)
    Workspace.drop_since(mark)


def block_lengths(spark: SparkSession, target: str) -> DataFrame:
    """(seq, length); of records with one name the first counts, in all lookups."""
    return _records(spark, target).select("seq", "length")


def _records(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(f"{target}/records").groupBy(F.col("name").alias("seq"))
    return rows.agg(F.min_by(F.struct("length", "body", "width"), "seq_ord").alias("r")).select("seq", "r.*")


def blocks_of_ranges(spark: SparkSession, target: str, ranges: DataFrame) -> DataFrame:
    """Rows of ``ranges(seq, start, end, ...)`` for each block that they touch, with its place and theirs in the text (``_b``).  Ranges
    without letters, or of unknown sequences, touch none.  No letters are read.

    Both sides meet in bins of a block's length: a block lies in two at most, and a pair counts in the bin where its overlap begins.
    """
    records = _records(spark, target)
    start, end = F.greatest("start", F.lit(0)), F.least("end", "length")

    def place(at: Column) -> Column:
        return F.col("body") + at + F.floor(at / F.col("width"))

    asked = ranges.join(records, "seq").where(end > start).withColumns({"_low": place(start), "_high": place(end - 1) + 1})
    asked = asked.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / BLOCK), F.floor((F.col("_high") - 1) / BLOCK))))
    blocks = spark.read.parquet(f"{target}/blocks")
    bins = F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("begin") + F.col("n") - 1) / BLOCK))
    blocks = blocks.select(F.struct("*").alias("_at"), F.explode(bins).alias("_bin"))
    meets = (F.col("_at.begin") < F.col("_high")) & (F.col("_at.begin") + F.col("_at.n") > F.col("_low"))
    found = asked.join(blocks, "_bin").where(meets & (F.col("_bin") == F.floor(F.greatest("_at.begin", "_low") / BLOCK)))
    return found.select(*(F.col(f"`{c}`") for c in ranges.columns), F.struct("_at.*", F.col("_low").alias("low"), F.col("_high").alias("high"), "body", "width").alias("_b"))


def _read(folder: str):
    """Adds the letters of ranges from their blocks; blocks that follow each other in a batch are read at once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, source, text, known = None, None, b"", None
        for batch in batches:
            asked = batch.column(batch.num_columns - 1).to_pylist()
            froms, letters = [], []
            held: dict[int, bytes] = {}
            for k, b in enumerate(asked):
                if b["file"] != name:
                    if source:
                        source.close()
                    name, source, known, held = b["file"], system.open_input_file(f"{root}/{b['file']}"), None, {}
                if b["at"] != known:
                    if b["at"] not in held:
                        run = [(b["at"], b["size"])]
                        for other in asked[k + 1 :]:
                            if other["file"] == name and other["at"] == sum(run[-1]) and len(run) < READ:
                                run.append((other["at"], other["size"]))
                            elif other["file"] != name or other["at"] != run[-1][0]:
                                break
                        source.seek(b["at"])
                        data = source.read(sum(run[-1]) - b["at"])
                        held = {at: data[at - b["at"] : at - b["at"] + size] for at, size in run}
                    text, known = zlib.decompress(held[b["at"]], 31), b["at"]
                low = max(b["low"], b["begin"])
                letters.append(text[low - b["begin"] : b["high"] - b["begin"]].replace(b"\n", b"").decode())
                froms.append(low - b["body"] - (low - b["body"]) // (b["width"] + 1))
            columns = [*batch.columns[:-1], pa.array(froms, pa.int64()), pa.array(letters, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "from", "letters"])
        if source:
            source.close()

    return read


def letters_of_blocks(spark: SparkSession, target: str, ranges: DataFrame) -> DataFrame:
    """Rows of ``ranges(seq, start, end, ...)``, one for each block that a range touches, with ``from`` (first position) and
    ``letters`` of that part.  What lies beyond the sequence has no letters; a range without any has one row of empty ones."""
    touched = blocks_of_ranges(spark, target, ranges).sortWithinPartitions("_b.file", "_b.at")
    schema = StructType([*ranges.schema.fields, StructField("from", LongType()), StructField("letters", StringType())])
    found = touched.mapInArrow(_read(f"{target}/text"), schema)
    rest = ranges.join(block_lengths(spark, target), "seq", "left").where("coalesce(least(end, length), 0) <= greatest(start, 0)")
    return found.unionByName(rest.select(*(F.col(f"`{c}`") for c in ranges.columns), F.col("start").cast("long").alias("from"), F.lit("").alias("letters")))


def fetch_blocks(spark: SparkSession, target: str, ranges: DataFrame) -> DataFrame:
    """``operators.sequences.fetch`` from block gzip: only the blocks that ranges touch are read."""
    return assembled(letters_of_blocks(spark, target, checked_ranges(ranges, block_lengths(spark, target))))


def block_chunks(spark: SparkSession, target: str, size: int = WIDTH * LINES) -> DataFrame:
    """(seq, chunk_no, chunk): a chunk table of all records, read by blocks in many tasks."""
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))
    ranges = block_lengths(spark, target).where("length > 0").select("seq", numbers.alias("chunk_no"))
    ranges = ranges.select("seq", "chunk_no", (F.col("chunk_no") * size).alias("start"), ((F.col("chunk_no") + 1) * size + OVERLAP).alias("end"))
    found = letters_of_blocks(spark, target, ranges).groupBy("seq", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("from", "letters"))).alias("ps"))
    return found.select("seq", "chunk_no", F.array_join(F.transform("ps", lambda p: p["letters"]), "").alias("chunk"))
