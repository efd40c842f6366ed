"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Terms are words and word shapes (runs of upper case, lower case, digits; punctuation as it is), pairs of successive shapes, and
words that repeat one of the three before them; words are hashed to ``WORD_TERMS`` columns, the others to ``SHAPE_TERMS``.  Rows
of square roots of term shares, weighted by inverse document frequency, are reduced to ``DIMENSIONS`` by a singular value
decomposition of labelled rows.  The labelled vectors are broadcast: there are ``LABELLED`` at most.  Every document is compared
with all of them by blocked cosine products; its ``NEIGHBOURS`` nearest vote with the power ``SHARPNESS`` of their similarity.
Cosines are rounded to six digits; of equal ones the voter that comes first in the broadcast table is the nearer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import WORDS_KEPT, word_lists
from .storage import lean_memory, small_batches

SHAPE_TERMS, WORD_TERMS = 4096, 4096
TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS = SHAPE_TERMS + WORD_TERMS, 64, 15, 4
#: Bounds of the sample of labelled rows, and of those that the decomposition is computed from.
LABELLED, DECOMPOSED = 6000, 2048
#: Rows that are dense, or compared with all voters, at a time: a worker holds few MB of either.
BLOCK_ROWS, GRAM_ROWS = 100, 256
_REPEATS = 3


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shape(word: str) -> str:
    word = re.sub(r"[^\W\d_]+", lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "Xx" if m[0][0].isupper() else "x", word)
    return re.sub(r"\d+", "9", word)


def term_rows(texts: pa.Array, cache: dict[bytes, tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its hashed terms, sorted, and the square roots of their shares; none for a text without words."""
    lists = word_lists(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    if len(cache) > WORDS_KEPT:
        cache.clear()
    known = []
    for w in coded.dictionary.cast(pa.large_binary()).to_pylist():
        got = cache.get(w)
        if got is None:
            got = (xxhash.xxh32_intdigest(shape(w.decode())), SHAPE_TERMS + xxhash.xxh32_intdigest(w.lower()) % WORD_TERMS) if w else (-1, -1)
            if len(w) < 100:
                cache[w] = got
        known.append(got)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    table = np.array(known, np.int64).reshape(-1, 2)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        c = codes[a:b]
        s, w = (table[c, 0], table[c, 1]) if len(c) else (np.zeros(0, np.int64),) * 2
        c, w, s = c[s >= 0], w[s >= 0], s[s >= 0]
        pairs = (s[:-1] * 31 + s[1:]) % 2**32
        again = [np.full(int((c[k:] == c[:-k]).sum()), 7 * k, np.int64) for k in range(1, _REPEATS + 1)]
        terms, counts = np.unique(np.concatenate([s % SHAPE_TERMS, (pairs * 2_654_435_761 >> 7) % SHAPE_TERMS, *again, w]), return_counts=True)
        yield terms, np.sqrt(counts / max(1, len(s))).astype(np.float32)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray | None = None) -> np.ndarray:
    dense = np.zeros((len(rows), TERMS), np.float32)
    for k, (terms, shares) in enumerate(rows):
        dense[k, terms] = shares if weight is None else shares * weight[terms]
    return dense


@dataclass
class Voters:
    """Labelled vectors and the projection of terms; ``prior`` is the score of texts without words or of no labels."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = _dense(rows) @ self.projection
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for at in range(0, len(rows), BLOCK_ROWS):
            block = rows[at : at + BLOCK_ROWS]
            # Whole numbers that hold the rounded cosine, negated, and the place, so no two are equal.
            n = len(self.vectors)
            cosines = self.embed(block) @ self.vectors.T
            cosines *= 1e6
            ranked = np.rint(cosines, out=cosines).astype(np.int64)
            ranked *= -n
            ranked += np.arange(n)
            ranked.partition(k - 1, axis=1)
            best = -ranked[:, :k]
            nearest = -best % n
            weights = np.clip((best + nearest) // n / 1e6, 0, 1) ** SHARPNESS
            total = weights.sum(axis=1)
            voted = (np.array([len(t) > 0 for t, _ in block])) & (total > 0)
            out[at : at + len(block)][voted] = ((weights * self.labels[nearest]).sum(axis=1) / np.maximum(total, 1e-300))[voted]
        return np.clip(out, 0, 1)


def _leading(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix, the ``DIMENSIONS`` largest among them.

    Small ones are decomposed whole.  For larger ones that takes eleven times their size (the library works in double precision),
    so three times as many vectors as wanted are multiplied by the matrix until their values stand still.
    """
    n = 3 * DIMENSIONS
    if len(gram) <= 2 * n:
        return np.linalg.eigh(gram)
    basis = np.random.default_rng(3).standard_normal((len(gram), n)).astype(np.float32)
    before = np.zeros(DIMENSIONS)
    for _ in range(60):
        basis = np.linalg.qr(gram @ np.linalg.qr(gram @ basis)[0])[0].astype(np.float32)
        values, turn = np.linalg.eigh(basis.T @ (gram @ basis))
        now = values[::-1][:DIMENSIONS]
        if np.abs(now - before).max() <= 1e-6 * now.max():
            break
        before = now
    return values, basis @ turn.astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Voters:
    full = [k for k, (t, _) in enumerate(rows) if len(t)]
    prior = float(labels.mean()) if len(labels) else 0.5
    if not full:
        return Voters(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    rows, labels = [rows[k] for k in full], labels[full]
    frequency = np.zeros(TERMS, np.int64)
    for terms, _ in rows:
        frequency[terms] += 1  # a row has each term once
    weight = np.log((1 + len(rows)) / (1 + frequency)).astype(np.float32) + 0.1
    some = rows[:DECOMPOSED]
    begins = range(0, len(some), GRAM_ROWS)
    gram = np.zeros((len(some), len(some)), np.float32)
    for a in begins:
        one = _dense(some[a : a + GRAM_ROWS], weight)
        for b in range(0, a + 1, GRAM_ROWS):
            products = one @ _dense(some[b : b + GRAM_ROWS], weight).T
            gram[a : a + GRAM_ROWS, b : b + GRAM_ROWS], gram[b : b + GRAM_ROWS, a : a + GRAM_ROWS] = products, products.T
    values, left = _leading(gram)  # left singular vectors and squared singular values
    top = np.argsort(values)[::-1][:DIMENSIONS]
    top = top[values[top] > 1e-6 * max(values.max(), 1e-30)]
    left = left[:, top]
    right = sum(_dense(some[a : a + GRAM_ROWS], weight).T @ left[a : a + GRAM_ROWS] for a in begins) / np.sqrt(values[top])
    voters = Voters(np.ascontiguousarray(weight[:, None] * right).astype(np.float32), np.zeros((0, 1), np.float32), labels.astype(float), prior)
    voters.vectors = np.concatenate([voters.embed(rows[at : at + BLOCK_ROWS]) for at in range(0, len(rows), BLOCK_ROWS)])
    return voters


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, int] = {}
    for batch in batches:
        rows = list(term_rows(batch.column(1), cache))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([t.astype(np.int32) for t, _ in rows], pa.list_(pa.int32())), pa.array([s for _, s in rows], pa.list_(pa.float32()))],
            names=["label", "terms", "shares"],
        )


def score_column(voters: Voters, text: Column, spark: SparkSession) -> Column:
    """Scores of a text column; the other columns of its rows do not pass through Python."""
    shared = spark.sparkContext.broadcast(voters)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean_memory()
        cache: dict[bytes, int] = {}
        for some in texts:
            yield pa.array(shared.value.score(list(term_rows(some, cache))), pa.float64())

    return score(text)


def learn_voters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Voters:
    """Voters from at most ``LABELLED`` labelled documents that are not held out, chosen by a hash of their ids.

    Null labels and ids are left out; an id with several labels has their mean; a label without document is left out.  Of
    documents that repeat an id the text that sorts first is learnt from.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("label", "text").mapInArrow(_terms, "label double, terms array<int>, shares array<float>")
    # A row for each id, so ``LABELLED`` at most: one task fits them, and the driver gets no more than the model.
    models = rows.repartition(1).mapInArrow(_fitted, "projection binary, vectors binary, labels binary, prior double").collect()
    if not models:
        return fit([], np.zeros(0))
    projection, vectors, prior = np.frombuffer(models[0].projection, np.float32).reshape(TERMS, -1), np.frombuffer(models[0].vectors, np.float32), models[0].prior
    return Voters(projection, vectors.reshape(-1, projection.shape[1]), np.frombuffer(models[0].labels, np.float64), prior)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the arrays of the voters that all rows (label, terms, shares) make."""
    lean_memory()
    pairs, known = [], []
    for batch in batches:
        label, terms, shares = (batch.column(c) for c in ("label", "terms", "shares"))
        known += label.to_pylist()
        flat, roots, bounds = terms.flatten().to_numpy(), shares.flatten().to_numpy(), terms.offsets.to_numpy()
        bounds = bounds - bounds[0]
        pairs += [(flat[a:b], roots[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]

    def compared(a: int, b: int) -> int:  # bytes of two rows at a time, not of all
        x, y = ((pairs[k][0].tobytes(), pairs[k][1].tobytes(), known[k]) for k in (a, b))
        return (x > y) - (x < y)

    order = sorted(range(len(pairs)), key=cmp_to_key(compared))
    order = [order[k] for k in np.random.default_rng(7).permutation(len(order))]  # independent of the order of rows
    voters = fit([pairs[k] for k in order], np.array([known[k] for k in order], float))
    arrays = [voters.projection.astype(np.float32), voters.vectors.astype(np.float32), voters.labels.astype(np.float64)]
    columns = [pa.array([x.tobytes()], pa.binary()) for x in arrays] + [pa.array([voters.prior])]
    yield pa.RecordBatch.from_arrays(columns, names=["projection", "vectors", "labels", "prior"])


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Null, empty and word-free texts get the mean of the labels, 0.5 if there are none.  Repeated rows are scored each; an
    empty table gives no rows.  Only doc_id and text of ``docs`` are read, and doc_id is no input of a score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.select("doc_id", score_column(learn_voters(docs, labels, doc_id, text, label), F.col("text"), spark).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``.

    Scores are those of ``quality_scores``: null, empty and word-free texts are judged by the mean of the labels; repeated rows
    are judged alike; without labels every score is 0.5.
    """
    small_batches(docs.sparkSession)
    return docs.where(score_column(learn_voters(docs, labels, doc_id, text, label), F.col(text), docs.sparkSession) >= threshold)
