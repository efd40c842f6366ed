"""Byte-level BPE: distinct pre-tokens of the corpus are encoded once, then joined back by position.

1. Texts are cut into pre-tokens, as the public library cuts them.  A block (the texts of one task, up to ``BLOCK_TOKENS``
   pre-tokens) becomes one row that holds each pre-token's position as an index into the block's list of distinct words.
   Blocks are named by their content, so a task that runs again makes the same ones, and both steps below read one shuffle.
2. These lists are shuffled by a hash of the word: all blocks' occurrences of a word meet in one bucket, which encodes each
   distinct one once.  Beyond ``BUCKETS`` buckets' worth of input the blocks are dealt to several such sets of buckets, so that
   neither a bucket grows without bound nor lists fall apart to single words; a word is then encoded once in each set.
3. The ids go back to their blocks, and texts are put together by position.

A word crosses the network once a block however often it occurs, so very frequent ones make no hot keys.  Lists travel packed:
as rows of (block, place, word) joined by word they take 2.3 times the input on disk where packed lists take about 1.3.  Decoding
joins ids with the table of token bytes, which is as small as the vocabulary.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean_memory, small_batches

BLOCK_TOKENS = 2_000_000
#: Bytes of input for each bucket of distinct words, and the most buckets in a set.
BUCKET_BYTES, BUCKETS = 8_000_000, 4096

CUT = "block binary, doc_ids array<long>, lengths array<long>, codes binary, buckets binary, lists array<struct<bucket:int,words:binary>>"
_LISTS = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))
_CUT_SCHEMA = pa.schema([("block", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary()), ("buckets", pa.binary()), ("lists", _LISTS)])


def rank_table(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the text of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def pack(items: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(items), *map(len, items)], "<u4").tobytes() + b"".join(items), 3)


def lengths_and_bytes(data: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths of the packed items, and all of them put together."""
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.frombuffer(data, "<u4", n + 1)[1:].astype(np.int64), data[4 * (n + 1) :]


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, which compress better than the numbers."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


@lru_cache
def stand_ins(pattern: str) -> dict[int, str]:
    """Code points that the library takes for other than the regular expressions here do (their tables of letters and numbers are
    of different ages), each with a character that both take for what the library does.

    A code point is a letter to the library if it stays in one piece with an ``a`` before it, which a vocabulary of single bytes
    and of pairs with ``a`` shows: only inside a piece are the two put together.  Likewise numbers after ``1``, and signs after
    ``!``; what is none of these is white space.
    """
    import regex
    import tiktoken

    encoders = []
    for lead, kind, stand_in in (("a", r"\p{L}", "é"), ("1", r"\p{N}", "½"), ("!", r"[^\s\p{L}\p{N}]", "¤"), ("", r"\s", "\u2003")):
        ranks = {bytes([b]): b for b in range(256)} | ({lead.encode() + bytes([b]): 256 + b for b in range(256)} if lead else {})
        encoders.append((lead, regex.compile(kind), stand_in, tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})))
    out = {}
    for begin in range(0, 0x110000, 0x4000):
        points = np.array([c for c in range(begin, begin + 0x4000) if not 0xD800 <= c < 0xE000], np.int64)
        chars = [chr(c) for c in points.tolist()]
        sizes = np.array([len(c.encode()) for c in chars], np.int64) + 2
        places = np.cumsum(sizes) - sizes
        settled = np.zeros(len(chars), bool)
        for lead, kind, stand_in, pairs in encoders:
            ours = np.array([kind.match(c) is not None for c in chars], bool)
            theirs = ~settled
            if lead and chars:
                ids = np.array(pairs.encode_ordinary("\n".join(lead + c for c in chars)))
                lengths = np.where(ids >= 256, 2, 1)
                theirs = ids[np.searchsorted(np.cumsum(lengths) - lengths, places)] >= 256
            settled |= theirs
            out |= {int(c): stand_in for c in points[theirs & ~ours]}
    return out


def splitter(pattern: str, unlike: dict[int, str]):
    """A function from a text to its pre-tokens; ``unlike`` is ``stand_ins(pattern)``."""
    import regex

    compiled = regex.compile(pattern)
    odd = {chr(c) for c in unlike}

    def split(text: str) -> list[str]:
        if text.isascii() or odd.isdisjoint(text):
            return compiled.findall(text)
        return [text[m.start() : m.end()] for m in compiled.finditer(text.translate(unlike))]

    return split


def _cutter(pattern: str, unlike, n_buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        split = splitter(pattern, unlike.value)
        known: dict[str, int] = {}
        ids, lengths, codes, total = [], [], [], 0

        def row() -> pa.RecordBatch:
            words = [w.encode() for w in known]
            bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(words)]
            parts = [{"bucket": int(bucket[order[a]]), "words": pack([words[k] for k in order[a:b].tolist()])} for a, b in zip(bounds[:-1], bounds[1:])]
            flat = _planes(np.concatenate(codes))
            name = xxhash.xxh3_128_digest(repr(ids).encode() + flat + b"".join(words))
            return pa.RecordBatch.from_pylist([{"block": name, "doc_ids": ids, "lengths": lengths, "codes": flat, "buckets": _planes(bucket), "lists": parts}], schema=_CUT_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [known.setdefault(w, len(known)) for w in split(text.as_py() or "")]
                ids.append(doc_id)
                lengths.append(len(found))
                codes.append(np.array(found, np.uint32))
                total += len(found)
                if total >= BLOCK_TOKENS or len(ids) >= BLOCK_TOKENS:
                    yield row()
                    known.clear()
                    ids, lengths, codes, total = [], [], [], 0
        if ids:
            yield row()

    return cut


def _lister(n_sets: int):
    """The lists of a block as rows.  Equal blocks give equal lists, which are needed once."""

    def lists(blocks: pa.Table) -> pa.Table:
        name, own = blocks["block"][0].as_py(), blocks["lists"][0].as_py()
        columns = [[name] * len(own), [zlib.crc32(name) % n_sets] * len(own), [x["bucket"] for x in own], [x["words"] for x in own]]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "set", "bucket", "words"])

    return lists


def _word_encoder(ranks_file):
    """Encodes every distinct word of a bucket once, for all blocks that have it."""

    def encode(table: pa.Table) -> pa.Table:
        import tiktoken

        lean_memory()
        # A word is one piece, so the library does not cut it again.
        ids_of = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=rank_table(ranks_file.value), special_tokens={}).encode_ordinary
        done: dict[bytes, bytes] = {}
        out = []
        for data in table["words"].to_pylist():
            lengths, flat = lengths_and_bytes(data)
            ids, at = [], 0
            for n in lengths.tolist():
                word = flat[at : at + n]
                at += n
                got = done.get(word)
                if got is None:
                    got = done[word] = np.array(ids_of(word.decode()), "<u4").tobytes()
                ids.append(got)
            out.append(pack(ids))
        return pa.table({"block": table["block"], "bucket": table["bucket"], "ids": pa.array(out, pa.binary())})

    return encode


class TokenBytes:
    """The table of token bytes, joined to ids by position."""

    def __init__(self, raw: bytes):
        tokens = sorted((rank, token) for token, rank in rank_table(raw).items())
        self.sizes = np.zeros(tokens[-1][0] + 1, np.int64)
        self.sizes[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gathered(self.flat, self.starts[ids], self.sizes[ids]).tobytes()


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of ``flat`` put together."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DECODED = ENCODED.append(pa.field("decoded", pa.binary()))


def _reassembler(ranks_file=None):
    """Ids of each text of a block, by the positions of its words; with a rank file their bytes too."""

    def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        lean_memory()
        table = TokenBytes(ranks_file.value) if ranks_file else None
        schema = DECODED if table else ENCODED
        out = []
        for row in texts.select(["doc_ids", "lengths", "codes", "buckets"]).to_pylist():
            codes, buckets = _numbers(row["codes"]), _numbers(row["buckets"])
            # Places of the words in order of buckets, as the lists have them.
            order = np.argsort(buckets, kind="stable")
            sorted_buckets = buckets[order]
            starts, sizes = np.zeros((2, len(buckets)), np.int64)
            parts, total = [], 0
            for bucket, data in zip(words["bucket"].to_pylist(), words["ids"].to_pylist()):
                lengths, ids = lengths_and_bytes(data)
                begin = int(np.searchsorted(sorted_buckets, bucket))
                places = order[begin : begin + len(lengths)]
                lengths //= 4
                sizes[places], starts[places] = lengths, total + np.cumsum(lengths) - lengths
                parts.append(ids)
                total += len(ids) // 4
            flat = np.frombuffer(b"".join(parts), "<u4")
            bounds = np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))]).tolist()
            columns = [row["doc_ids"], [], [], []]
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = gathered(flat, starts[codes[a:b]], sizes[codes[a:b]])
                columns[1].append(len(own))
                columns[2].append(own.tobytes())
                if table:
                    columns[3].append(table.decode(own))
            out.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return reassemble


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), without special tokens; if asked also
    decoded, the bytes of the ids, which spares handing the ids to Python once more.

    Each match of ``pattern`` is encoded by itself.  Null and empty texts have no tokens.  Repeated rows and rows without
    doc_id are encoded each; an empty table gives none; other columns are not read.  ``ranks_path`` is read on the driver
    and sent to executors: it is as small as the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        ranks_file = spark.sparkContext.broadcast(f.read())
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 2**53:  # plans over files know their size, others give the largest number there is and are measured
        size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wanted = max(8, size // BUCKET_BYTES)
    n_buckets, n_sets = min(BUCKETS, wanted), -(-wanted // BUCKETS)
    blocks = source.mapInArrow(_cutter(pattern, spark.sparkContext.broadcast(stand_ins(pattern)), n_buckets), CUT).repartition("block")
    words = blocks.groupBy("block").applyInArrow(_lister(n_sets), "block binary, set int, bucket int, words binary")
    ids = words.groupBy("set", "bucket").applyInArrow(_word_encoder(ranks_file), "block binary, bucket int, ids binary")
    columns = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_reassembler(ranks_file if decode else None), columns)


def _decoder(ranks_file):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        table = TokenBytes(ranks_file.value)
        for batch in batches:
            texts = [table.decode(np.frombuffer(data or b"", "<u4")) for data in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return decode


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows of ``bpe_encode``; null ids decode to no bytes, an unknown id fails the job."""
    with open(ranks_path, "rb") as f:
        ranks_file = encoded.sparkSession.sparkContext.broadcast(f.read())
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(ranks_file), "doc_id long, n_tokens long, ids binary, decoded binary")
