"""Audit of how the sources of a language differ in their use of words, on integer dictionaries of the kept terms.

1. Tasks cut texts into terms and count them for each (lang, source), with the documents that hold each; only sums are shuffled.
2. Terms in enough documents of their language are kept and dealt by a hash to chunks.  A chunk holds its terms as a sorted array,
   so the place that ``searchsorted`` gives is the term's id and ids are in the order of UTF-8 bytes; ``bincount`` then gives dense
   vectors, one for each source of the language.
3. A chunk gives the sum of differences of every two sources, and the best terms of each source with ties by id; sums and ranks over
   chunks are Spark's.  The number of chunks follows the number of cells, so a chunk is bounded whatever the vocabulary is.

All numbers are integers: shares of counts are in billionths, and products beyond 64 bits are computed as Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace, lean_memory, small_batches

#: A term is kept if so many documents of its language hold it.
LEAST_DOCUMENTS = 30
#: Added to each count, and what shares are multiples of.
PRIOR, UNIT = 5, 1_000_000_000
#: Terms that are reported of each source.
TOP = 50
#: Counts (sources times terms) of one chunk.
CELLS = 50_000
#: Pairs of (group, term) or (text, term) that a task gathers before it sums them up, and sums before it hands them on.
GATHERED, HELD = 4_000_000, 1_000_000

#: Every byte of a term as it is, A-Z lower-cased; all others as a blank.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, as UTF-8: runs of letters A-Z, a-z and of characters beyond ASCII, with only A-Z lower-cased."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values)


class _Counts:
    """Counts of one task: groups and terms are numbered as they come; a key is group << 32 | term."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, langs: list, sources: list, texts: list) -> None:
        groups = np.array([self.groups.setdefault((a or "", b or ""), len(self.groups)) for a, b in zip(langs, sources)], np.int64)
        words = [terms_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        coded = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
        number = np.array([self.terms.setdefault(w, len(self.terms)) for w in coded.dictionary.to_pylist()], np.int64)
        if not len(number):
            return
        # Once for each text and term, then once for each group and term.
        of_text = np.repeat(np.arange(len(texts)), lengths) * len(number) + coded.indices.to_numpy(zero_copy_only=False)
        pairs, n = np.unique(of_text, return_counts=True)
        keys = groups[pairs // len(number)] << 32 | number[pairs % len(number)]
        self.parts.append(_summed(keys, n.astype(np.int64), np.ones(len(n), np.int64)))
        self.size += len(self.parts[-1][0])

    def sum_up(self) -> None:
        if len(self.parts) > 1:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts)))]
        self.size = sum(len(p[0]) for p in self.parts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Sums, and for each group a row without a term, so that groups without terms are known."""
        self.sum_up()
        names = list(self.groups)
        yield pa.RecordBatch.from_pylist([{"lang": a, "source": b, "n": 0, "docs": 0} for a, b in names], schema=_COUNTED)
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        langs, sources = (pa.array(x, pa.string()) for x in zip(*names)) if names else (None, None)
        for keys, n, docs in self.parts:
            for at in range(0, len(keys), 100_000):
                some = slice(at, at + 100_000)
                group, term = keys[some] >> 32, keys[some] & (2**32 - 1)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), terms.take(pa.array(term)), pa.array(n[some]), pa.array(docs[some])], schema=_COUNTED)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean_memory()
    counts = _Counts()
    for batch in batches:
        counts.add(*(c.to_pylist() for c in batch.columns))
        if counts.size > GATHERED:
            counts.sum_up()
            if counts.size > HELD:
                yield from counts.rows()
                counts = _Counts()
    yield from counts.rows()


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), exact for counts of any size."""
    if total + PRIOR < 2**63 // UNIT:
        return 1 + UNIT * (counts + PRIOR) // (total + PRIOR * kept)
    return np.array([1 + UNIT * (c + PRIOR) // (total + PRIOR * kept) for c in counts.tolist()], np.int64)


_FOUND = pa.schema([("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _chunk(top: int):
    """Of one chunk of one language: counts of its terms, and the language's sources with their totals."""

    def found(rows: pa.Table, groups: pa.Table) -> pa.Table:
        lean_memory()
        groups = groups.sort_by("source")
        names = groups["source"].to_pylist()
        terms = np.unique(np.array(rows["term"].cast(pa.binary()).to_pylist(), object))  # in the order of UTF-8
        n_sources, n_terms = len(names), len(terms)
        if not n_terms:
            return _FOUND.empty_table()
        ids = np.searchsorted(terms, np.array(rows["term"].cast(pa.binary()).to_pylist(), object))
        source = pc.index_in(rows["source"], value_set=groups["source"].combine_chunks()).to_numpy()
        counts = np.bincount(source.astype(np.int64) * n_terms + ids, weights=rows["n"].to_numpy(), minlength=n_sources * n_terms)
        counts = counts.astype(np.int64).reshape(n_sources, n_terms)
        kept, of_lang = groups["kept"][0].as_py(), groups["lang_total"][0].as_py()
        p = np.stack([shares(c, t, kept) for c, t in zip(counts, groups["total"].to_pylist())])
        q = shares(counts.sum(axis=0), of_lang, kept)
        out = []
        for i in range(n_sources - 1):
            sums = np.abs(p[i + 1 :] - p[i]).sum(axis=1)
            out.append(pa.table([pa.array([names[i]] * len(sums)), pa.array(["pair"] * len(sums)), pa.array(names[i + 1 :]), pa.array(sums)], schema=_FOUND))
        for i in range(n_sources):
            over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            best = over[np.argsort(-(p[i] - q)[over], kind="stable")][:top]
            if len(best):
                items = pa.array(terms[best].tolist(), pa.binary()).cast(pa.string())
                out.append(pa.table([pa.array([names[i]] * len(best)), pa.array(["term"] * len(best)), items, pa.array((p[i] - q)[best])], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    def with_lang(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
        table = found(rows, groups)
        return table.add_column(0, "lang", pa.repeat(key[0].cast(pa.string()), len(table)))

    return with_lang


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank (from 1 for each source and part, value descending, then item in UTF-8 order).

    Part ``pair``: item is another source of the language, value the sum over the language's kept terms of the differences of the
    two shares; 0 if no term is kept.  Part ``term``: item is a term that the source has and uses more than the language does, value
    the difference of the shares, the first ``top`` only.  Null texts, languages and sources are empty strings; groups without terms
    have their pairs; each row is a document, repeated ones too; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "divergence")
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = space.keep(counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_documents)
    kept = space.keep(kept.select("lang", "term", "n"))
    rows = counted.where("term IS NOT NULL").join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    rows = space.keep(rows.select("lang", "source", "term", "n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = space.keep(counted.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long"))).join(langs, "lang", "left"))

    cells = groups.groupBy("lang").agg((F.count("*") * F.max("kept")).alias("cells")).agg(F.max("cells")).first()[0] or 0
    n_chunks = -(-cells // CELLS) or 1
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(n_chunks)).cast("int"))
    shown = groups.where("kept IS NOT NULL").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    found = dealt.groupBy("lang", "chunk").cogroup(shown.groupBy("lang", "chunk")).applyInArrow(_chunk(top), "lang string, source string, part string, item string, value long")
    found = space.keep(found)

    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    ranked = pairs.unionByName(found.where("part = 'term'"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
