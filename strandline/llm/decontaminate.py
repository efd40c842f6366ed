"""Benchmark decontamination: BM25 over an inverted index of test items, block-max bounds, then overlap checks.

Every training text is cut into windows of 2 S words that begin every S words, S being the length of the longest of all items,
so any passage as long as an item lies whole in one.  Document frequencies, mean length and S are counted in Spark over the
whole benchmark; the postings are then dealt to indexes of bounded size, so scores and windows do not depend on their number.  Windows query the index of test items.  Weights are divided by each item's own
threshold, the least score that a window passing the overlap check can reach, so 1 is the threshold of all items and
retrieval loses nothing.  Items lie in blocks; a window's sum of block maxima below 1 skips the block, as in block-max WAND,
whose test is taken here for all windows of a batch at once instead of by a cursor for each.

A retrieved item counts as leaked if the window holds ``MIN_SHINGLES`` of its distinct 5-word shingles and ``MIN_PART`` of the
distinct words of both its question and its answer (its last sentence).  Words are compared lower-cased, without punctuation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .shingles import WIDTH
from .storage import Workspace, lean_memory, small_batches

K1, B = 1.2, 0.75
MIN_SHINGLES, MIN_PART = 0.8, 0.6
BLOCK_ITEMS = 16
#: Items of one index; the postings of a larger benchmark are dealt to several.
INDEX_ITEMS = 2048
#: Terms of windows whose postings are looked up at once.
LOOKED_UP = 200_000
LEAKS = "array<struct<item_id:bigint,score:double,overlap:double>>"
#: What a byte of a text in UTF-8 is to its word.
BLANK, LEFT_OUT, PART, BEYOND_ASCII = range(4)
_KIND = np.array([BEYOND_ASCII if b > 127 else BLANK if b in b" \t\n\v\f\r" else PART if re.match(r"\w", chr(b)) else LEFT_OUT for b in range(256)], np.uint8)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # A-Z only


def normal(word: str) -> str:
    return "".join(re.findall(r"\w+", word.lower()))


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, re.split(r"[\x20\x09-\x0D]+", text or "")) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; an item of one sentence has its last quarter of words as answer."""
    sentences = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+|\n", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut] or words, words[cut:]


def shingles(words: list) -> set[tuple]:
    return {tuple(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))} if words else set()


@dataclass
class Index:
    """Inverted index of a bounded number of items; ``bounds`` are the maxima of each term's weights in each block."""

    items: list[int]
    words: pa.Array
    bounds: np.ndarray
    pointers: np.ndarray
    posting_items: np.ndarray
    posting_weights: np.ndarray
    checks: list[tuple[set, set, set]]
    stride: int


def build_index(rows: list[tuple[int, str, dict[str, int]]], n_items: int, mean: float, stride: int) -> Index | None:
    """rows: (item_id, text, document frequencies of its words); the other values are those of all items.

    Items without words, or without an id, are left out; None if no item is left.
    """
    rows = sorted(((i, t, f) for i, t, f in rows if i is not None and words_of(t)), key=lambda r: r[:2])
    if not rows:
        return None
    texts = [words_of(t) for _, t, _ in rows]
    vocabulary: dict[str, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in ws] for ws in texts]
    frequency = {vocabulary[w]: n for _, _, f in rows for w, n in f.items()}
    n_blocks = -(-len(rows) // BLOCK_ITEMS)
    bounds = np.zeros((len(vocabulary), n_blocks), np.float32)
    postings = []
    checks = []
    for k, ws in enumerate(coded):
        weights = {}
        for t, n in Counter(ws).items():
            idf = math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5))
            weights[t] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ws) / mean))
        whole = shingles(ws)
        # A missing distinct word breaks a shingle at least: so many of the heaviest may be missing.
        missing = math.floor((1 - MIN_SHINGLES) * len(whole) + 1e-9)
        least = sum(sorted(weights.values())[: max(1, len(weights) - missing)])
        for t, w in weights.items():
            postings.append((t, k, w / least * (1 + 1e-5)))
            bounds[t, k // BLOCK_ITEMS] = max(bounds[t, k // BLOCK_ITEMS], postings[-1][2])
        question, answer = question_and_answer(rows[k][1])
        checks.append((whole, {vocabulary[w] for w in question}, {vocabulary[w] for w in answer}))
    postings.sort()
    terms = np.array([p[0] for p in postings], np.int64)
    at = np.array([p[1] for p in postings], np.int64)
    pointers = np.searchsorted(terms * (n_blocks * BLOCK_ITEMS) + at, np.arange(len(vocabulary) * n_blocks + 1) * BLOCK_ITEMS)
    return Index([r[0] for r in rows], pa.array(list(vocabulary), pa.large_string()).cast(pa.large_binary()), bounds, pointers, at, np.array([p[2] for p in postings]), checks, stride)


def word_codes(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``known`` (UTF-8) of all words of a batch in order, -1 if not there, and for each text where its words begin (n+1 bounds).

    Words are those of ``words_of``.  They are cut and looked up by array operations over the bytes of the whole batch; those
    with characters beyond ASCII are lower-cased and stripped as one string, a word a line.
    """
    whole = [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]
    data = np.frombuffer(b"\n".join([b"", *whole, b""]), np.uint8)
    first = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in whole], dtype=np.int64)])
    kind = _KIND[data]
    blank = kind == BLANK
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    part = kind >= PART
    sizes = np.add.reduceat(part, starts, dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[part]])])
    codes = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
    beyond = np.maximum.reduceat(kind, starts) == BEYOND_ASCII
    if beyond.any():
        inside = np.zeros(len(data), bool)
        inside[starts[0] :] = np.repeat(beyond, np.diff(starts, append=len(data)))
        inside[1:] &= ~(blank[1:] & blank[:-1])  # a word and the blank after it
        lines = np.where(blank[inside], np.uint8(10), data[inside]).tobytes().decode().lower()
        others = pa.array(re.sub(r"[^\w\n]+", "", lines).split("\n")[:-1], pa.large_string()).cast(pa.large_binary())
        codes[beyond] = pc.fill_null(pc.index_in(others, value_set=known), -1).to_numpy()
        sizes[beyond] = pc.binary_length(others).to_numpy()
    real = sizes > 0
    return codes[real], np.concatenate([[0], np.cumsum(real)])[np.searchsorted(starts, first)]


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _leaks_of(index: Index, terms: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
    """(text, item, score, overlap) for each window that holds an item.  terms: codes of all words of a batch, -1 if in no item;
    begins: where those of each text begin (n+1 bounds)."""
    stride, n_blocks = index.stride, index.bounds.shape[1]
    known = np.flatnonzero(terms >= 0)
    if not len(known):
        return
    sizes = np.diff(begins)
    first_window = np.concatenate([[0], np.cumsum(sizes // stride + 1)])
    doc_of = np.repeat(np.arange(len(sizes)), sizes)[known]
    term, place = terms[known], known - begins[doc_of]
    own = first_window[doc_of] + place // stride
    high = index.bounds.max(axis=1)
    # A window is a stride and the next one of its text.
    sums = np.bincount(own, weights=high[term], minlength=first_window[-1])
    following = np.append(sums[1:], 0)
    following[first_window[1:] - 1] = 0
    kept = sums + following >= 1
    here, before = kept[own], (place >= stride) & kept[own - 1]
    pairs = np.concatenate([own[here] * len(high) + term[here], (own[before] - 1) * len(high) + term[before]])
    if not len(pairs):
        return
    pairs.sort()
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    window, term = pairs // len(high), pairs % len(high)
    starts = np.flatnonzero(np.diff(window, prepend=-1))
    lengths = np.diff(starts, append=len(window))
    alive = np.add.reduceat(high[term], starts) >= 1
    starts, lengths = starts[alive], lengths[alive]
    for at in range(0, len(starts), 2000):
        some, n_terms = starts[at : at + 2000], lengths[at : at + 2000]
        bounds = np.add.reduceat(index.bounds[term[_ranges(some, n_terms)]], np.cumsum(n_terms) - n_terms, axis=0)
        rows, blocks = np.nonzero(bounds >= 1)
        step = max(1, LOOKED_UP // (2 * stride))
        for k in range(0, len(rows), step):
            row, block = rows[k : k + step], blocks[k : k + step]
            for pair, place, score in _scored(index, term, some[row], n_terms[row], block):
                item, number = int(block[pair]) * BLOCK_ITEMS + place, int(window[some[row[pair]]])
                doc = int(np.searchsorted(first_window, number, "right")) - 1
                begin = int(begins[doc]) + (number - int(first_window[doc])) * stride
                inside = terms[begin : min(begin + 2 * stride, int(begins[doc + 1]))].tolist()
                whole, question, answer = index.checks[item]
                width = min(WIDTH, len(next(iter(whole))))
                seen = {tuple(inside[i : i + width]) for i in range(len(inside) - width + 1)}
                overlap, held = len(whole & seen) / len(whole), set(inside)
                if overlap >= MIN_SHINGLES and all(len(p & held) >= MIN_PART * len(p) for p in (question, answer)):
                    yield doc, item, score, overlap


def _scored(index: Index, term: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(pair, place in its block, score) of the items that reach their threshold, for pairs of a window's terms and a block."""
    pair = np.repeat(np.arange(len(block)), lengths)
    cell = term[_ranges(starts, lengths)] * index.bounds.shape[1] + block[pair]
    begins = index.pointers[cell]
    n = index.pointers[cell + 1] - begins
    rows = _ranges(begins, n)
    at = np.repeat(pair, n) * BLOCK_ITEMS + index.posting_items[rows] % BLOCK_ITEMS
    scores = np.bincount(at, weights=index.posting_weights[rows], minlength=len(block) * BLOCK_ITEMS)
    for k in np.flatnonzero(scores >= 1).tolist():
        yield k // BLOCK_ITEMS, k % BLOCK_ITEMS, float(scores[k])


def leak_column(index: Index, text: Column, spark: SparkSession) -> Column:
    """For each text an array of (item_id, score, overlap); the other columns of its rows do not pass through Python."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(LEAKS)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean_memory()
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())]))
        for some in texts:
            yield pa.array(_search(shared.value, some), kind)

    return search(text)


def _search(index: Index, texts: pa.Array) -> list[list[dict]]:
    terms, begins = word_codes(texts, index.words)
    best: list[dict[int, tuple[float, float]]] = [{} for _ in range(len(texts))]
    for doc, item, score, overlap in _leaks_of(index, terms, begins):
        best[doc][item] = max(best[doc].get(item, (0.0, 0.0)), (score, overlap))
    return [[{"item_id": index.items[i], "score": s, "overlap": o} for i, (s, o) in sorted(found.items())] for found in best]


@F.arrow_udf(ArrayType(StringType()))
def _item_words(texts: pa.Array) -> pa.Array:
    return pa.array([words_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes over slices of about ``INDEX_ITEMS`` items each, which come to the driver one at a time."""
    space = Workspace(benchmark.sparkSession, "items")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.withColumn("words", _item_words(F.col("text"))).where("size(words) > 0")
    items = space.keep(items.withColumn("row", F.monotonically_increasing_id()))
    n_items, mean, stride = items.agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words"))).first()
    if not n_items:
        return
    terms = items.select("row", F.explode(F.array_distinct("words")).alias("word"))
    frequent = terms.groupBy("word").agg(F.count("*").alias("n"))
    counted = terms.join(frequent, "word").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("frequency"))
    n_slices = -(-n_items // INDEX_ITEMS)
    dealt = space.keep(items.join(counted, "row").select("item_id", "text", "frequency", F.pmod(F.xxhash64("row"), F.lit(n_slices)).alias("slice")))
    for k in range(n_slices):
        index = build_index([(r.item_id, r.text, r.frequency) for r in dealt.where(F.col("slice") == k).collect()], n_items, mean, stride)
        if index:
            yield index
    space.drop_all_but()


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of ``docs`` and test item that it holds: doc_id, item_id, score (BM25 over the item's threshold,
    of the best window), overlap (share of the item's shingles in that window).

    Null and empty texts hold nothing; items without id or words match nothing; equal items are each reported; repeated rows
    of ``docs`` each give theirs.  Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = spark.createDataFrame([], "doc_id long, item_id long, score double, overlap double")
    for index in indexes(benchmark, item_id, item_text):
        found = found.unionByName(source.select("doc_id", leak_column(index, F.col("text"), spark).alias("found")).select("doc_id", F.inline("found")))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item.

    Null and empty texts hold nothing and stay; repeated rows are judged alike; items without id or words match nothing.
    """
    small_batches(docs.sparkSession)
    for index in indexes(benchmark, item_id, item_text):
        docs = docs.where(F.size(leak_column(index, F.col(text), docs.sparkSession)) == 0)
    return docs
