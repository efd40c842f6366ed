"""Similarity join of documents by the Jaccard index of their word shingles, on XOR sketches.

Sets that share ``link`` per cent of their union have sizes within that ratio, so bands of sizes that grow by it hold a pair in one
band or in two neighbours; a set goes to its own band and, if it can have partners there, to the next.  In a band two linked sets
differ in at most D shingles.  The hash space is cut into k > D pieces, and a set's sketch has for each piece the XOR of its shingles
there: one differing shingle changes one piece, so the number of pieces that differ is at most the number of shingles that do, and
k - D pieces at least are equal (pigeonhole).

Equal pieces are found by a join on piece and value.  Since k exceeds D + 1, the commonest pieces need not be looked at: in one
order by frequency for all sets, the first D + 1 pieces of two linked sets have one in common.  Empty pieces come last, so they are
handed on only by sets with fewer other ones than D + 1.  Most documents have more than D pieces that no other set has, and are
done.  A passage that many documents share makes common pieces, which all but its copies leave out.

Nothing is capped, and no step has a chance of missing a link.  Texts with equal sets form one class.  In each bucket (piece and
value) every class is compared with one hub on full sets; what links is joined into components.  In buckets that hold several components still, parity
sketches, in which each shingle turns one bit, are compared: their Hamming distance is a lower bound of the symmetric difference, so
pairs beyond D are out, and the others are compared on full sets.  Sets are compared as 64-bit fingerprints of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .near_dups import compare_with_hubs, sets_of_classes
from .shingles import mix, shingle_sets
from .storage import Workspace, lean_memory, small_batches

#: Per cent of the union that linked sets share, unless given.
LINK = 80
#: Pieces for each shingle that linked sets of a band may differ in.
SLACK = 1.3
#: Keys that a task gathers before it deals them out, and keys of one bucket of the join; a byte of text makes a tenth of a key.
GATHERED, BUCKET_KEYS, KEYS_A_BYTE = 500_000, 1_000_000, 0.1
#: Members of a bucket that are compared with each other in one task at a time.
ROOM = 1024
_U = np.uint64


@lru_cache
def bands(link: int) -> np.ndarray:
    """Least sizes of the bands; sets of bands that are no neighbours cannot link."""
    lows = [1]
    while lows[-1] < 2**40:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * 100 // link)))
    return np.array(lows, np.int64)


def differences(sizes: int, link: int) -> int:
    """The most shingles that two linked sets differ in, given the sum of their sizes."""
    return sizes * (100 - link) // (100 + link)


@lru_cache(10_000)
def scheme(band: int, link: int) -> tuple[int, int]:
    """Of a band: the most shingles that linked sets differ in, and the number of pieces."""
    most = differences(2 * (int(bands(link)[band + 1]) - 1), link)
    return most, int(most * SLACK) + 4


def piece_keys(shingles: np.ndarray, band: int, link: int) -> tuple[np.ndarray, int]:
    """Keys of a set's pieces in a band, and how many pieces may be left out (negative: so many are wanting, and the empty ones are
    among the keys)."""
    most, k = scheme(band, link)
    piece = ((shingles >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)  # in the order of shingles
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    at, value = piece[starts], np.bitwise_xor.reduceat(shingles, starts)
    spare = len(at) - most - 1
    if spare < 0:
        empty = np.setdiff1d(np.arange(k), at)
        at, value = np.concatenate([at, empty]), np.concatenate([value, np.zeros(len(empty), _U)])
    return mix(value ^ mix(at.astype(_U) << _U(16) ^ _U(band))), spare


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits, 4 to 8 for each shingle, as bytes."""
    bits = max(8, 1 << int(4 * len(shingles) - 1).bit_length())
    at = (shingles >> _U(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch made shorter: neighbouring bits become their parity, so distances stay lower bounds."""
    while len(bits) > size:
        pairs = np.unpackbits(bits).reshape(-1, 2)
        bits = np.packbits(pairs[:, 0] ^ pairs[:, 1])
    return bits


_OWN = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("owner", pa.int64()), ("spare", pa.int32()), ("spare_next", pa.int32())]))
_CUT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("runs", pa.binary()), ("docs", _OWN)])
CUT = "bucket int, keys binary, owners binary, runs binary, docs array<struct<doc_id:bigint,n:bigint,cls:binary,owner:bigint,spare:int,spare_next:int>>"


def _cutter(n_buckets: int, link: int):
    """Documents with the digests of their sets, and the keys of all pieces, dealt to buckets.

    An owner is half of a class digest whose last bit tells the next band: the two bands of a class are counted apart.
    """

    def dealt(keys: list[np.ndarray], owners: list[int]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(k) for k in keys])
        flat = np.concatenate(keys)
        owner = np.repeat(np.arange(len(keys)), sizes)
        bucket = (flat % _U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        flat, owner, bucket = flat[order], owner[order], bucket[order]
        bounds = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(flat)]
        names = np.array(owners, _U)
        for a, b in zip(bounds[:-1], bounds[1:]):
            starts = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            runs = np.diff(np.append(starts, b - a)).astype("<u4")
            row = [[int(bucket[a])], [flat[a:b].tobytes()], [names[owner[a:b][starts]].tobytes()], [runs.tobytes()], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _CUT)], schema=_CUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        known: dict[bytes, dict] = {}
        keys, owners, size = [], [], 0
        lows = bands(link)
        for batch in batches:
            docs = []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                if not len(s):
                    docs.append({"doc_id": doc_id, "n": 0})
                    continue
                cls = xxhash.xxh3_128_digest(s.tobytes())
                if cls not in known:
                    home = int(np.searchsorted(lows, len(s), "right")) - 1
                    owner, spares = int.from_bytes(cls[:8], "little") & (2**64 - 2), []
                    for k in range(1 + (100 * len(s) >= link * int(lows[home + 1]))):
                        own, spare = piece_keys(s, home + k, link)
                        keys.append(own)
                        owners.append(owner | k)
                        spares.append(spare)
                        size += len(own)
                    known[cls] = {"cls": cls, "owner": int(np.uint64(owner).view(np.int64)), "spare": spares[0], "spare_next": spares[-1]}
                docs.append({"doc_id": doc_id, "n": len(s)} | known[cls])
            # Rows of documents go to any bucket, the same one if the task runs again.
            name = xxhash.xxh32_intdigest(repr([(d["doc_id"], d["n"]) for d in docs]))
            yield pa.RecordBatch.from_pylist([{"bucket": name % n_buckets, "docs": docs}], schema=_CUT)
            if size >= GATHERED:
                yield from dealt(keys, owners)
                known.clear()
                keys, owners, size = [], [], 0
        if keys:
            yield from dealt(keys, owners)

    return cut


_MET = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("owner", pa.int64()), ("spare", pa.int32()), ("spare_next", pa.int32()), ("key", pa.int64()), ("often", pa.int64())])
MET = "doc_id long, n long, cls binary, owner long, spare int, spare_next int, key long, often long"


def _meet(table: pa.Table) -> pa.Table:
    """Documents as rows, and of the keys that several classes have a row for each of them, with their number."""
    lean_memory()
    docs = pa.concat_arrays([c.flatten() for c in table["docs"].chunks]) if table.num_rows else pa.array([], _OWN.value_type)
    out = [pa.table([*docs.flatten(), *(pa.nulls(len(docs), pa.int64()) for _ in range(2))], schema=_MET)]
    packed = [(k, o, r) for k, o, r in zip(*(table[c].to_pylist() for c in ("keys", "owners", "runs"))) if k is not None]
    if packed:
        keys = np.concatenate([np.frombuffer(k, "<u8") for k, _, _ in packed])
        owners = np.concatenate([np.repeat(np.frombuffer(o, "<u8"), np.frombuffer(r, "<u4")) for _, o, r in packed])
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        first = np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])]  # copies of a class in several tasks
        keys, owners = keys[first], owners[first]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.append(starts, len(keys)))
        often = np.repeat(n, n)
        some = often > 1
        columns = {"key": keys[some].view(np.int64), "owner": owners[some].view(np.int64), "often": often[some]}
        out.append(pa.table([pa.array(columns[f.name]) if f.name in columns else pa.nulls(int(some.sum()), f.type) for f in _MET], schema=_MET))
    return pa.concat_tables(out)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [sketch(np.frombuffer(s, _U)).tobytes() for s in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(bits, pa.binary())], names=["cls", "n", "bits"])


def _room(link: int, every: bool):
    """Pairs (hub, cls) of the classes of a room that no component joins and whose sketches allow a link.  Side 0 meets side 1, if there
    is one.  A room with more pairs than classes gives, unless ``every`` one is asked for, the nearest of each class, and a row with
    its key alone."""

    def near(table: pa.Table) -> pa.Table:
        lean_memory()
        names, sizes = table["cls"].to_pylist(), table["n"].to_numpy()
        _, roots = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)
        side = table["side"].to_numpy()
        raw = [np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()]
        least = min(map(len, raw))
        bits = np.stack([folded(b, least) for b in raw])
        two = side.min() != side.max()
        found, nearest, n_pairs = [], [], 0
        for i in range(len(names)):
            if two and side[i]:
                continue
            others = np.flatnonzero(side == 1) if two else np.arange(i + 1, len(names))
            others = others[roots[others] != roots[i]]
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            ok = apart * (100 + link) <= (sizes[others] + sizes[i]) * (100 - link)
            ok &= 100 * np.minimum(sizes[others], sizes[i]) >= link * np.maximum(sizes[others], sizes[i])
            if not ok.any():
                continue
            n_pairs += int(ok.sum())
            nearest.append((i, int(others[ok][np.argmin(apart[ok])])))
            if every or n_pairs <= len(names):
                found += [(i, j) for j in others[ok].tolist()]
        again = not every and n_pairs > len(names)
        pairs = sorted({(min(names[i], names[j]), max(names[i], names[j])) for i, j in (nearest if again else found)})
        columns = [[a for a, _ in pairs] + [None] * again, [b for _, b in pairs] + [None] * again, [None] * len(pairs) + [table["key"][0].as_py()] * again]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()))], names=["hub", "cls", "again"])

    return near


def _rooms(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, i, j, cls, root, side): classes of the buckets with several components, in blocks of about ``ROOM`` that meet in pairs."""
    rooted = buckets.select("key", "cls").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    marks = [F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"), F.count("*").alias("n")]
    mixed = rooted.groupBy("key").agg(*marks, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = mixed.groupBy("n", "x", "y").agg(F.min("key").alias("key"))  # of those with the same classes one is enough
    rooms = rooted.join(mixed.select("key", F.floor(F.col("n") / ROOM).cast("int").alias("more")), "key")
    rooms = rooms.withColumn("own", F.expr("cast(pmod(xxhash64(cls), more + 1) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), "more")))
    return rooms.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "root", (F.col("own") > F.col("other")).cast("int").alias("side"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link: int = LINK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (size of its set) and component_id (least doc_id that links reach).

    Sets link that share ``link`` per cent of their union.  Null and word-free texts have the empty set and link with nothing: their
    component is their own doc_id.  Equal texts link.  Rows that repeat a doc_id are documents of their own and share what that id
    reaches; a row without doc_id links like any other and takes the least id of its component, if there is one.  An empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = Workspace(spark, "jaccard")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 2**53:  # plans over files know their size, others are measured
        size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = min(2**20, max(8, int(size * KEYS_A_BYTE / BUCKET_KEYS)))
    cut = source.mapInArrow(_cutter(n_buckets, link), CUT)
    met = space.keep(cut.groupBy("bucket").applyInArrow(_meet, MET))

    signed = met.where("n IS NOT NULL").select("doc_id", "n", "cls")
    classes = met.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"), *(F.first(c).alias(c) for c in ("owner", "spare", "spare_next")))
    classes = space.keep(classes)

    # The first D + 1 pieces by frequency; pieces that no other class has are among them.
    owners = classes.select("owner", "spare", "cls").unionByName(classes.select((F.col("owner") + 1).alias("owner"), F.col("spare_next").alias("spare"), "cls"))
    shared = met.where("key IS NOT NULL").select("key", "owner", "often")
    counted = shared.withColumn("n_shared", F.count("*").over(Window.partitionBy("owner"))).withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("often", "key")))
    wanted = counted.join(owners, "owner").where("place <= n_shared - spare").select("key", "cls").distinct()
    several = wanted.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets = space.keep(wanted.join(several.select("key", "hub"), "key"))

    sets = sets_of_classes(source, classes, space.keep(buckets.select("cls").distinct()), space)
    seen = space.keep(compare_with_hubs(buckets.where("cls <> hub").select("hub", "cls").distinct(), sets))
    links = seen.where(f"100 * common >= {link} * whole").select(F.col("hub").alias("u"), F.col("cls").alias("v"))
    roots = space.keep(connected_components(links, space))

    # Buckets with several components.  In those with many pairs each class is first tried with the nearest one of another component,
    # which leaves few components, then all pairs of these are tried.
    sketches = space.keep(sets.mapInArrow(_sketches, "cls binary, n long, bits binary"))
    for every in (False, True):
        rooms = _rooms(buckets, roots).join(sketches, "cls")
        near = space.keep(rooms.groupBy("key", "i", "j").applyInArrow(_room(link, every), "hub binary, cls binary, again long").distinct())
        more = space.keep(compare_with_hubs(near.where("hub IS NOT NULL").select("hub", "cls"), sets)).where(f"100 * common >= {link} * whole")
        roots = space.keep(connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more.select(F.col("hub").alias("u"), F.col("cls").alias("v"))), space))
        many = near.where("again IS NOT NULL").select(F.col("again").alias("key")).distinct()
        if many.isEmpty():
            break
        buckets = space.keep(buckets.join(many, "key", "left_semi"))

    found = classes.select("cls", "first_id", "n_docs").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("least_id"))
    found = found.join(least, "root", "left").where("root IS NOT NULL OR n_docs > 1").select("cls", F.coalesce("least_id", "first_id").alias("component_id"))
    found = space.keep(found)
    space.drop_all_but(met, found)
    return signed.join(found, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
