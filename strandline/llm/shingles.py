"""Word shingles of Arrow text batches as 64-bit fingerprints, computed with array operations over a whole batch.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z only.  A text's shingle set holds the fingerprints of
its distinct 5-word shingles; a shorter text has its whole word sequence as the only shingle; a text without words
(or a null text) has the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDTH = 5
#: Words that a task remembers what it has computed of.
WORDS_KEPT = 100_000
_U = np.uint64
#: Odd multiplier of the polynomial that combines the word fingerprints of a shingle.
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that fingerprints behave like random values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Words of each text in their own case; nulls count as empty texts.  Blanks at the edges leave empty strings."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels below want arrays that are no slices
    return pc.split_pattern_regex(texts, r"[\x20\x09-\x0D]+")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of the batch in order, and for each text the index at which its words begin (n+1 bounds)."""
    lists = word_lists(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in distinct), dtype=_U, count=len(distinct))  # bytes: A-Z only
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = np.fromiter(map(bool, distinct), dtype=bool, count=len(distinct))[codes]
    before = np.concatenate([[0], np.cumsum(real)])
    return table[codes[real]], before[offsets]


def shingle_sets(texts: pa.Array):
    """Yields, for each text, its sorted array of distinct shingle fingerprints."""
    words, bounds = word_hashes(texts)
    n = len(words)
    if n >= WIDTH:
        windows = np.zeros(n - WIDTH + 1, _U)
        for k in range(WIDTH):
            windows = windows * _STEP + words[k : n - WIDTH + 1 + k]
        windows = mix(windows)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - begin >= WIDTH:
            yield np.unique(windows[begin : end - WIDTH + 1])
        elif end > begin:
            total = _U(end - begin)
            with np.errstate(over="ignore"):
                for w in words[begin:end]:
                    total = total * _STEP + w
            yield mix(np.array([total], _U))
        else:
            yield np.zeros(0, _U)
