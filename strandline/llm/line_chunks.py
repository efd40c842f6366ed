"""Line deduplication on content-defined line chunks, in Spark SQL functions only.

A rolling hash over the hashes of two successive lines ends a chunk wherever it is divisible by ``DIVISOR``; lines of
``LONG_WORDS`` words or more stand alone.  Both depend on nearby lines alone, so text inserted elsewhere in a document shifts
no boundary.  Chunks of several lines, and long lines, that occur more than once in the corpus are compared by their bytes; all
occurrences but the first (least doc_id, then place) are removed.

Boundaries alone leave the ends of a passage of short lines, which share their chunks with other lines.  So later copies of any
run of lines with ``LONG_WORDS`` words in all go too, wherever it lies between the boundaries.  Such a run is covered by the
shortest runs of so many words that begin or end at one of its lines, and each of those occurs again with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

DIVISOR = 2
LONG_WORDS = 50


def n_words(line: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+", -1), lambda w: w != F.lit("")))


def _pieces(text: Column, divisor: int, long_words: int) -> Column:
    """Chunks of a text in order: begin (number of the first line), words, and part, an array of lines with md5, hash and words."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    seen = F.transform(lines, lambda x: F.struct(x.alias("line"), F.md5(x).alias("md5"), n_words(x).alias("words")))
    seen = F.transform(seen, lambda x: F.struct(x["line"].alias("line"), x["md5"].alias("md5"), F.conv(F.substring(x["md5"], 1, 8), 16, 10).cast("long").alias("hash"), x["words"].alias("words")))

    def ends(xs: Column) -> Column:
        last = F.size(xs)

        def is_end(i: Column) -> Column:
            here, after = F.element_at(xs, i), F.element_at(xs, F.least(i + 1, last))
            before = F.when(i > 1, F.element_at(xs, F.greatest(i - 1, F.lit(1)))["hash"]).otherwise(F.lit(0))
            return (i == last) | ((before * 31 + here["hash"]) % divisor == 0) | (here["words"] >= long_words) | (after["words"] >= long_words)

        return F.filter(F.sequence(F.lit(1), last), is_end)

    def cut(pair: Column) -> Column:
        xs, stops = pair["xs"], pair["stops"]

        def piece(stop: Column, k: Column) -> Column:
            begin = F.when(k > 0, F.element_at(stops, F.greatest(k, F.lit(1)))).otherwise(F.lit(0)) + 1
            part = F.slice(xs, begin, stop - begin + 1)
            total = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["words"])
            return F.struct(begin.cast("long").alias("begin"), total.alias("words"), part.alias("part"))

        return F.transform(stops, piece)

    # A one-element array binds each intermediate once for the functions that use it several times.
    bound = F.transform(F.array(seen), lambda xs: F.struct(xs.alias("xs"), ends(xs).alias("stops")))
    return F.flatten(F.transform(bound, cut))


def _text_of(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda x: x["line"]), "\n")


def _removable(piece: Column, long_words: int) -> Column:
    return ((F.size(piece["part"]) > 1) | (piece["words"] >= long_words)) & (piece["words"] > 0)


def chunk_lists(text: Column, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> Column:
    """Chunks of a text in order; joined by newlines they give the text."""
    return F.transform(_pieces(text, divisor, long_words), lambda c: _text_of(c["part"]))


#: A key with more than this share of all rows is joined by broadcast: there are at most 1 / ``HOT`` of them.
HOT = 1e-3


def _key(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))


def _spread_join(rows: DataFrame, keys: DataFrame, on: str, total: int) -> DataFrame:
    """``rows.join(keys, on)`` for distinct keys with their number ``n`` of ``total`` rows; very frequent keys make no large task."""
    hot = F.broadcast(keys.where(F.col("n") > HOT * total))
    rest = rows.join(hot, on, "left_anti").join(keys.where(F.col("n") <= HOT * total), on)
    return rows.join(hot, on).unionByName(rest)


def _line_entries(text: Column, divisor: int, long_words: int) -> Column:
    """Lines with words, in order: number in the text, words, digest, digest of the lines without words before it (or null), and
    for the first such line of a removable chunk the chunk's first line, number of lines and digest."""

    def of_piece(c: Column) -> Column:
        name = F.when(_removable(c, long_words), F.struct(c["begin"].alias("begin"), F.size(c["part"]).cast("long").alias("lines")))
        return F.transform(c["part"], lambda x, i: F.struct(x["line"].alias("line"), x["md5"].alias("md5"), x["words"].alias("words"), name.alias("chunk")))

    every = F.flatten(F.transform(_pieces(text, divisor, long_words), of_piece))

    def entries(b: Column) -> Column:
        xs, at = b["xs"], b["at"]

        def entry(p: Column, k: Column) -> Column:
            before = F.when(k > 0, F.element_at(at, F.greatest(k, F.lit(1)))).otherwise(F.lit(0))
            blank = F.when((k > 0) & (p > before + 1), F.md5(_text_of(F.slice(xs, before + 1, p - before - 1))))
            own = F.element_at(xs, p)
            chunk = own["chunk"]
            whole = F.slice(xs, chunk["begin"].cast("int"), chunk["lines"].cast("int"))
            # A chunk is named by its first line with words.
            named = F.when(before < chunk["begin"], F.struct(chunk["begin"].alias("begin"), chunk["lines"].alias("lines"), F.unhex(F.sha2(_text_of(whole), 256)).alias("digest")))
            return F.struct(p.cast("long").alias("line"), own["words"].cast("long").alias("words"), F.unhex(own["md5"]).alias("digest"), F.unhex(blank).alias("blank"), named.alias("chunk"))

        return F.transform(at, entry)

    bound = F.transform(F.array(every), lambda xs: F.struct(xs.alias("xs"), F.filter(F.sequence(F.lit(1), F.size(xs)), lambda i: F.element_at(xs, i)["words"] > 0).alias("at")))
    return F.flatten(F.transform(bound, entries))


def _repeated_chunks(space: Workspace, rows: DataFrame, lines: DataFrame, divisor: int, long_words: int) -> DataFrame:
    """row_key, low and high (numbers of lines) of each chunk to remove."""
    wanted = F.filter(_pieces(F.col("text"), divisor, long_words), lambda c: _removable(c, long_words))
    chunks = rows.select(F.explode(F.transform(wanted, lambda c: _text_of(c["part"]))).alias("chunk"))
    # Grouping by the chunk itself compares bytes; its digest then names it in rows without text.
    same = space.keep(chunks.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select(F.unhex(F.sha2("chunk", 256)).alias("digest"), "n"))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", F.col("chunk.begin").alias("low"))
    found = lines.where("chunk IS NOT NULL").select(F.col("chunk.digest").alias("digest"), at.alias("at"), (F.col("chunk.begin") + F.col("chunk.lines") - 1).alias("high"))
    total = found.count()
    found = space.keep(_spread_join(found, same, "digest", total))
    first = found.groupBy("digest").agg(F.min("at").alias("first"), F.max("n").alias("n"))
    return _spread_join(found.drop("n"), first, "digest", total).where("at <> first").select("at.row_key", "at.low", "high")


def _repeated_runs(space: Workspace, lines: DataFrame, long_words: int) -> DataFrame:
    """row_key, low and high (numbers of lines) of the later copies of the shortest runs with ``long_words`` words."""
    lines = lines.select("doc_id", "row_key", "k", "line", "words", "digest", "blank")
    # A run occurs again only if each line of it does, so few lines go on.  Identical rows are one document.
    same = space.keep(lines.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
    lines = _spread_join(lines, same, "digest", lines.count()).dropDuplicates(["row_key", "k"])
    by_row = Window.partitionBy("row_key").orderBy("k")
    lines = lines.withColumn("island", F.col("k") - F.row_number().over(by_row))
    lines = lines.withColumn("end", F.sum("words").over(Window.partitionBy("row_key", "island").orderBy("k")))
    # Whole words before and after, made unique by the line's place: a range of them is exactly the shortest run.
    unit = 2**31
    lines = lines.withColumns({"start_key": (F.col("end") - F.col("words")) * unit + F.col("k"), "end_key": F.col("end") * unit + F.col("k")})
    ahead = Window.partitionBy("row_key", "island").orderBy("start_key").rangeBetween(0, long_words * unit - 1)
    back = Window.partitionBy("row_key", "island").orderBy("end_key").rangeBetween(1 - long_words * unit, 0)
    part = F.struct("line", "words", "digest", "blank")
    runs = lines.select("doc_id", "row_key", F.collect_list(part).over(ahead).alias("ahead"), F.collect_list(part).over(back).alias("back"))
    runs = runs.select("doc_id", "row_key", F.explode(F.array("ahead", "back")).alias("run"))
    runs = runs.where(F.aggregate("run", F.lit(0).cast("long"), lambda a, x: a + x["words"]) >= long_words)
    bytes_of = F.transform("run", lambda x, i: F.concat(F.when((i > 0) & x["blank"].isNotNull(), F.concat(F.lit("+"), F.hex(x["blank"]))).otherwise(F.lit("-")), F.hex(x["digest"])))
    low, high = F.element_at("run", 1)["line"], F.element_at("run", -1)["line"]
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", low.alias("low"))
    runs = space.keep(runs.select(at.alias("at"), high.alias("high"), F.unhex(F.sha2(F.array_join(bytes_of, ""), 256)).alias("digest")).distinct())
    first = runs.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("at", "high")).alias("first")).where("n > 1")
    later = _spread_join(runs, first, "digest", runs.count()).where("at <> first.at")
    # A copy that begins within the first occurrence takes only what follows that.
    within = F.col("at.row_key") == F.col("first.at.row_key")
    return later.select("at.row_key", F.when(within, F.greatest(F.col("at.low"), F.col("first.high") + 1)).otherwise(F.col("at.low")).alias("low"), "high")


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """row_key and ranges (sorted array of low and high, numbers of lines from 1) for the rows of ``docs`` that lose lines."""
    space = Workspace(docs.sparkSession, "line-chunks")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row_key", _key(F.col("doc_id"), F.col("text")))
    lines = rows.select("doc_id", "row_key", F.posexplode(_line_entries(F.col("text"), divisor, long_words)).alias("k", "l"))
    lines = space.keep(lines.select("doc_id", "row_key", "k", "l.*"))
    gone = _repeated_chunks(space, rows, lines, divisor, long_words).unionByName(_repeated_runs(space, lines, long_words))
    gone = gone.groupBy("row_key", "low").agg(F.max("high").alias("high"))
    by_row = Window.partitionBy("row_key").orderBy("low")
    gone = gone.withColumn("reach", F.max("high").over(by_row.rowsBetween(Window.unboundedPreceding, -1)))
    gone = gone.withColumn("k", F.sum((F.col("reach").isNull() | (F.col("low") > F.col("reach") + 1)).cast("long")).over(by_row))
    gone = gone.groupBy("row_key", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    gone = space.keep(gone.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges")))
    space.drop_all_but(gone)
    return gone


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """The rows of ``docs`` as columns ``row`` (struct of all their columns), doc_id, text (without repeated lines), n_removed
    (stretches of lines that are removed) and removed_lines.

    A null text is an empty one.  Rows that repeat both doc_id and text are one document here and get the same result; null
    ids come last.  What is repeated stays where it occurs first, within a document too; of runs that overlap in one document
    the first stays whole.  An empty table gives no rows.
    """
    gone = removals(docs, doc_id, text, divisor, long_words)
    given = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = given.withColumn("row_key", _key(F.col("doc_id"), F.col("text"))).join(gone.hint("shuffle_hash"), "row_key", "left")

    def left(b: Column) -> Column:
        lines, ranges = b["lines"], b["ranges"]

        def before(r: Column, k: Column) -> Column:
            begin = F.when(k > 0, F.element_at(ranges, F.greatest(k, F.lit(1)))["high"] + 1).otherwise(F.lit(1)).cast("int")
            return F.slice(lines, begin, (r["low"] - begin).cast("int"))

        last = (F.element_at(ranges, -1)["high"] + 1).cast("int")
        rest = F.slice(lines, last, F.size(lines) - last + 1)
        return F.array_join(F.concat(F.flatten(F.transform(ranges, before)), rest), "\n")

    bound = F.transform(F.array(F.struct(F.split("text", "\n", -1).alias("lines"), "ranges")), left)
    return joined.select(
        "row",
        "doc_id",
        F.when(F.col("ranges").isNotNull(), F.element_at(bound, 1)).otherwise(F.col("text")).alias("text"),
        F.when(F.col("ranges").isNull(), 0).otherwise(F.size("ranges")).cast("long").alias("n_removed"),
        F.when(F.col("ranges").isNull(), 0).otherwise(F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["high"] - r["low"] + 1)).cast("long").alias("removed_lines"),
    )
