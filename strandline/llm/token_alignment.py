"""Alignment of the tokens of two public tokenizers by byte offsets, with corpus-wide counts of linked ids.

1. A task encodes whole texts with both tokenizers.  The lengths of the tokens' bytes, summed up, give where each token ends in the
   batch; offsets at which tokens of both end (``intersect1d``) cut the tokens into groups, and ``searchsorted`` gives each token its
   group.  Every A token of a group is linked with every B token; repeats of ids within a group are counted before pairs are made
   by ``repeat``, so that a long group of few ids makes few pairs.
2. A block is what a task gathers up to ``BLOCK_LINKS`` distinct pairs of ids and texts.  It keeps for each text the pairs (as
   numbers in the block's list of distinct pairs) and how often each is linked.
3. Each block hands on its distinct pairs with the number of its texts that hold them.  They are summed in two steps, by pair and
   salt and then by pair, so the commonest pairs make no large task.  Counts then go back to the blocks, where a pair crosses the
   network once a block however many texts hold it, and texts sum theirs up.

Blocks are named by what they hold and written as a table, so a task that runs again makes the same ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, lean_memory, small_batches

#: Pairs (of a text and two ids) that a block holds before it ends.
BLOCK_LINKS = 3_000_000
#: Code points of texts that are encoded, and pairs that are made, at a time.
PART_CHARS, PART_PAIRS = 1_000_000, 4_000_000
SALTS = 16
#: An id pair as one number.
_PAIR = 2**32

#: Characters that all tables of letters, numbers and blanks agree on.  Texts of these are encoded by the faster library, whose
#: ranks are the same vocabulary; texts with others by the tokenizer file's own.
_LONG_BLANK = re.compile(r"\s{1000}")  # too deep for the faster library
_AGREED = re.compile("[\x00-ɏ‐-‧€]*")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on in turn."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, from the contents of their files, and the bytes of their tokens (a_bytes and b_bytes, by id)."""

    def __init__(self, bpe_json: bytes, piece_model: bytes, pattern: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(bpe_json.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        alphabet = byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        # Special tokens are not of the alphabet's making and never come out.
        as_bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocabulary.items() if all(c in alphabet for c in t)}
        self.a_bytes = Strings([as_bytes.get(i, b"") for i in range(max(vocabulary.values()) + 1)])
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {as_bytes[i]: i for t, i in vocabulary.items() if i in as_bytes and t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        pieces = [(self.b.is_byte(i), self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.b_bytes = Strings([bytes([int(p[3:-1], 16)]) if byte else p.replace("▁", " ").encode() for byte, p in pieces])
        # Each id in decimal with room for what stands behind it.
        self.decimal = Strings([f"{i},".encode() for i in range(max(len(self.a_bytes.sizes), len(pieces)))])

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by both; empty texts have none."""
        odd = [k for k, t in enumerate(texts) if t and (_LONG_BLANK.search(t) or not _AGREED.fullmatch(t))]
        slow = dict(zip(odd, self.a.encode_batch_fast([" " + texts[k] for k in odd], add_special_tokens=False)))
        a = [(slow[k].ids if k in slow else self.fast.encode_ordinary(" " + t)) if t else [] for k, t in enumerate(texts)]
        return a, self.b.encode(texts, num_threads=1)


class Strings:
    """Byte strings by number, which are gathered for many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        return self.flat[np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def groups_of(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A and each B token, and the number of groups; both sizes have the same sum."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    # Tokens are of a byte at least, so ends rise.
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), len(cuts)


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of the distinct (group, id), sorted."""
    keys, n = np.unique(group * _PAIR + ids, return_counts=True)
    return keys // _PAIR, keys % _PAIR, n


def linked_pairs(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of (group, pair of ids, number of links), in order of groups, each of about ``PART_PAIRS`` rows at most."""
    ga, ia, na = _counted(group_a, a)
    gb, ib, nb = _counted(group_b, b)
    begin_b, width = np.searchsorted(gb, np.arange(n_groups)), np.bincount(gb, minlength=n_groups)
    total = np.cumsum(width[ga])  # pairs up to each row of A
    at = 0
    while at < len(ga):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PART_PAIRS, "right")))
        repeats = width[ga[at:stop]]
        left = np.repeat(np.arange(at, stop), repeats)
        right = np.repeat(begin_b[ga[at:stop]] - (np.cumsum(repeats) - repeats), repeats) + np.arange(repeats.sum())
        yield ga[left], ia[left] * _PAIR + ib[right], na[left] * nb[right]
        at = stop


def alignment_texts(decimal: Strings, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;a3|b2,b3;``, and where each group ends."""
    until_a, until_b = np.searchsorted(group_a, np.arange(n_groups), "right"), np.searchsorted(group_b, np.arange(n_groups), "right")
    place_a = np.arange(len(a)) + np.append(0, until_b)[group_a]  # after the B tokens of the groups before
    place_b = np.arange(len(b)) + until_a[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    last_a, last_b = place_a[until_a - 1], place_b[until_b - 1]
    mark[last_a], mark[last_b] = ord("|"), ord(";")
    text, ends = decimal.joined(ids), np.cumsum(decimal.sizes[ids])
    text[ends - 1] = mark
    return text.tobytes(), ends[last_b]


def _packed(x: np.ndarray, kind: str = "<u4") -> bytes:
    return zstandard.compress(x.astype(kind).tobytes(), 1)


def _unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind).astype(np.int64)


_TEXT = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()), ("n_pairs", pa.int64())])
_BLOCK = pa.schema([("block", pa.binary()), ("texts", pa.list_(_TEXT)), ("numbers", pa.binary()), ("links", pa.binary()), ("pairs", pa.binary()), ("n_texts", pa.binary())])
BLOCK = "block binary, texts array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,sha:string,n_pairs:bigint>>, numbers binary, links binary, pairs binary, n_texts binary"


class _Block:
    def __init__(self):
        self.texts: list[dict] = []
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.size = 0

    def add(self, text: dict, pairs: np.ndarray, links: np.ndarray) -> None:
        self.texts.append(text | {"n_pairs": len(pairs)})
        self.pairs.append(pairs)
        self.links.append(links)
        self.size += len(pairs) + 1

    def row(self) -> pa.RecordBatch:
        distinct, numbers, n_texts = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        links = np.concatenate(self.links)
        data = [_packed(numbers), _packed(links, "<u8" if len(links) and links.max() >= 2**32 else "<u4"), _packed(distinct, "<u8"), _packed(n_texts)]
        name = xxhash.xxh3_128_digest(repr([(t["doc_id"], t["sha"]) for t in self.texts]).encode() + data[0])
        return pa.RecordBatch.from_pylist([{"block": name, "texts": self.texts, "numbers": data[0], "links": data[1], "pairs": data[2], "n_texts": data[3]}], schema=_BLOCK)


def _aligner(files, pattern: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        both = Tokenizers(*files.value, pattern)
        block = _Block()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            bounds = np.cumsum([len(t) for t in texts]) // PART_CHARS
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(bounds)) + 1):
                some = part.tolist()
                for text, pairs, links in aligned(both, [doc_ids[k] for k in some], [texts[k] for k in some]):
                    block.add(text, pairs, links)
                    if block.size >= BLOCK_LINKS:
                        yield block.row()
                        block = _Block()
        if block.texts:
            yield block.row()

    return align


def _whole(strings: Strings, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each text whether the bytes of its tokens are those of the text."""
    ends = np.cumsum(strings.sizes[ids])
    stops = np.append(0, ends)[np.cumsum(counts)].tolist()
    data = memoryview(strings.joined(ids).tobytes())
    return np.array([data[x:y] == t for x, y, t in zip([0, *stops[:-1]], stops, texts)], bool)


def aligned(both: Tokenizers, doc_ids: list, texts: list[str]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """For each text its row, its distinct id pairs and how often each is linked."""
    sides, kept = [], np.array([bool(t) for t in texts], bool)
    wanted = [b" " + t.encode() if t else b"" for t in texts]
    for encoded, strings in zip(both.encode(texts), (both.a_bytes, both.b_bytes)):
        counts = np.array([len(e) for e in encoded], np.int64)
        ids = np.fromiter(chain.from_iterable(encoded), np.int64, counts.sum())
        kept &= _whole(strings, ids, counts, wanted)
        sides.append((ids, counts))
    (a, n_a), (b, n_b) = ((ids[np.repeat(kept, counts)], np.where(kept, counts, 0)) for ids, counts in sides)
    # Texts end where tokens of both do, so no group reaches over two texts.
    group_a, group_b, n_groups = groups_of(both.a_bytes.sizes[a], both.b_bytes.sizes[b])
    last = np.append(group_a + 1, 0)[np.cumsum(n_a) - 1]  # groups up to the end of each text with tokens
    first = np.concatenate([[0], np.maximum.accumulate(np.where(n_a > 0, last, 0))])
    pairs, links = _by_text(first, group_a, a, group_b, b, n_groups)
    data, ends = alignment_texts(both.decimal, a, b, group_a, group_b, n_groups)
    stops = np.append(0, ends)[first].tolist()
    for k, doc_id in enumerate(doc_ids):
        groups = int(first[k + 1] - first[k])
        sha = hashlib.sha256(data[stops[k] : stops[k + 1] - 1]).hexdigest() if groups else ""
        row = {"doc_id": doc_id, "n_a": int(n_a[k]), "n_b": int(n_b[k]), "n_groups": groups, "n_links": int(links[k].sum()), "sha": sha}
        yield row, pairs[k], links[k]


def _by_text(first: np.ndarray, group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, n_groups: int) -> tuple[list, list]:
    """Distinct pairs and their links for each text; first: the number of the first group of each."""
    n = len(first) - 1
    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
    for group, pair, links in linked_pairs(group_a, a, group_b, b, n_groups):
        text = np.searchsorted(first, group, "right") - 1
        parts = [np.concatenate(x) for x in zip(held, (text, pair, links))]
        order = np.lexsort((parts[1], parts[0]))
        text, pair, links = (x[order] for x in parts)
        starts = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])
        held = text[starts], pair[starts], np.add.reduceat(links, starts)
    bounds = np.searchsorted(held[0], np.arange(1, n))
    return np.split(held[1], bounds), np.split(held[2], bounds)


HANDED = "block binary, at int, a int, b int, n long"


def _hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, at, a, b, n): the distinct pairs of blocks by their place in the block's list."""
    lean_memory()
    for batch in batches:
        for name, pairs, n_texts in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "n_texts"))):
            pairs, n = _unpacked(pairs, "<u8"), _unpacked(n_texts)
            for at in range(0, len(pairs), 100_000):
                some = pairs[at : at + 100_000]
                columns = [pa.repeat(pa.scalar(name, pa.binary()), len(some)), pa.array(np.arange(at, at + len(some)), pa.int32()), pa.array(some // _PAIR, pa.int32()), pa.array(some % _PAIR, pa.int32()), pa.array(n[at : at + 100_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "a", "b", "n"])


_DONE = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    lean_memory()
    out = []
    at = counts["at"].to_numpy()
    for row in blocks.to_pylist():
        numbers = _unpacked(row["numbers"])
        data = zstandard.decompress(row["links"])
        links = np.frombuffer(data, "<u8" if len(data) == 8 * len(numbers) else "<u4").astype(np.int64)
        size = int(at.max()) + 1 if len(at) else 0
        count, best = np.zeros(size, np.int64), np.zeros(size, bool)
        count[at], best[at] = counts["count"].to_numpy(), counts["best"].to_numpy()
        text = np.repeat(np.arange(len(row["texts"])), [t["n_pairs"] for t in row["texts"]])
        sums, bests = np.zeros((2, len(row["texts"])), np.int64)
        np.add.at(sums, text, links * count[numbers])
        np.add.at(bests, text, links * best[numbers])
        texts = row["texts"]
        columns = [*([t[c] for t in texts] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), bests, sums, [t["sha"] for t in texts]]
        out.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, _DONE)], schema=_DONE))
    return pa.concat_tables(out) if out else _DONE.empty_table()


def _blocks(docs: DataFrame, bpe_json: str, piece_model: str, pattern: str, doc_id: str, text: str, space: Workspace) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    contents = []
    for path in (bpe_json, piece_model):
        with open(path, "rb") as f:
            contents.append(f.read())
    files = spark.sparkContext.broadcast(tuple(contents))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return space.keep(source.mapInArrow(_aligner(files, pattern), BLOCK))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count): texts that hold a pair linked, of ``pairs(block, a, b, n)``."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)))
    return salted.groupBy("a", "b", "salt").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("count"))


def _rated(counts: DataFrame) -> DataFrame:
    """(a, b, count, best): best if the A id has no pair of more."""
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, bpe_json: str, piece_model: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair no other pair of its A id
    exceeds), count_sum (texts that hold a link's pair, summed over links) and groups_sha256.

    A is the byte-level tokenizer of ``bpe_json`` over a space and the text, B the one of ``piece_model``, which adds the space itself;
    strings of special tokens are plain text.  Null and empty texts, and those whose bytes a tokenizer changes, have no tokens: zeros
    and an empty digest.  Repeated rows are texts of their own; rows without doc_id count like any other; an empty table gives no
    rows; other columns are not read.  Both files are read on the driver and sent to executors: they are as small as the vocabularies.
    """
    space = Workspace(docs.sparkSession, "alignment")
    blocks = _blocks(docs, bpe_json, piece_model, pattern, doc_id, text, space)
    pairs = blocks.select("block", "pairs", "n_texts").mapInArrow(_hand_on, HANDED)
    counts = space.keep(pair_counts(pairs))
    rated = space.keep(_rated(counts))
    back = pairs.join(rated, ["a", "b"]).select("block", "at", "count", "best")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_finish, DONE)


def alignment_links(docs: DataFrame, bpe_json: str, piece_model: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus-wide table of linked ids: a, b, count (texts that hold the pair) and best (no other pair of ``a`` has more)."""
    space = Workspace(docs.sparkSession, "alignment")
    blocks = _blocks(docs, bpe_json, piece_model, pattern, doc_id, text, space)
    pairs = blocks.select("block", "pairs", "n_texts").mapInArrow(_hand_on, HANDED)
    return _rated(space.keep(pair_counts(pairs)))
