"""MinHash near-duplicate detection with tensored banding and verification on whole shingle sets.

Each text gets two collections of half keys, each made of ``ROWS`` minhashes.  Table key (i, j) joins half key i of
the first with half key j of the second collection, so 24 half keys of 3 minhashes make 144 tables of 6: a plain banding would
need 864 minhashes where 72 are computed.  A pair of similarity s meets in a table with probability (1-(1-s^3)^12)^2; a pair of
just 0.85 is missed with probability 2.2e-5, one of 0.9 with 3.1e-7.  The threshold is a parameter and sets the number of half
keys: for 0.8 there are 16 in each collection, 256 tables, and a pair of just 0.8 is missed with probability 2.1e-5.

Nothing is capped.  Texts with equal sets form one class.  A quarter of the tables, those of half keys whose numbers are the same or
follow each other closely, come first: in each bucket every class is compared with a hub, and what links so is known.  The other
tables then matter only where a bucket holds classes that are not linked yet; there, too, every class is compared with a hub.  Each
table is looked at once and no class is compared twice with one hub.  The Jaccard distance is a metric, so two classes
within d of each other are both within 0.45 + d of the hub, or both beyond 0.45: the first are compared with each other in blocks
(hubs of one component share theirs), the second stay in the bucket for another hub.  Buckets left after ``ROUNDS`` hubs are
compared in blocks as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import shingle_sets
from .storage import Workspace, lean_memory, small_batches

ROWS, ROUNDS = 3, 3
#: Share of the tables that come first.
FIRST = 0.25
#: Per cent of the union that linked sets share, unless given.
LINK = 85
#: A pair at the threshold has no common half key in one collection with this probability at most.
MISSED = 1.1e-5
#: Per cent of the union that a class shares with its hub, or else it stays in the bucket for another hub.
FAR = 55
#: Shingles of all the sets in one block of a group.
BLOCK_SHINGLES = 400_000
#: Shingles of all the sets of a cluster that is compared as a whole: three blocks, with themselves and each other.
CLUSTER_SHINGLES = 1_200_000
#: Ids of texts that are broadcast at most, a few megabytes.
FEW_IDS = 200_000
#: Members of a hub that one task compares with it.
HUB_SHARE = 500
_U = np.uint64


def halves_for(link: int) -> int:
    """Half keys of each collection."""
    return math.ceil(math.log(MISSED) / math.log(1 - (link / 100) ** ROWS))


@lru_cache
def _seeds(halves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    xor = rng.integers(0, 2**64, 2 * halves * ROWS, dtype=_U)
    odd = rng.integers(0, 2**64, 2 * halves * ROWS, dtype=_U) | _U(1)
    return xor, odd, rng.integers(0, 2**64, 2 * halves, dtype=_U)


def half_keys(shingles: np.ndarray, halves: int) -> np.ndarray:
    """The 2 * ``halves`` half keys of a non-empty set."""
    xor, odd, salt = _seeds(halves)
    least = np.full(len(xor), 2**64 - 1, _U)
    for at in range(0, len(shingles), 512):
        block = (shingles[at : at + 512, None] ^ xor) * odd
        np.minimum(least, block.min(axis=0), out=least)
    least = (least >> _U(16)).reshape(-1, ROWS)
    key = salt.copy()
    for k in range(ROWS):
        key = (key ^ least[:, k]) * _U(0x9E3779B97F4A7C15)
        key ^= key >> _U(29)
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], n_halves: int) -> Iterator[pa.RecordBatch]:
    lean_memory()
    for batch in batches:
        schema = pa.schema([("doc_id", batch.column(0).type), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("halves", pa.list_(pa.int64()))])
        sizes, classes, halves = [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            halves.append(half_keys(s, n_halves) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean_memory()
    schema = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        data = [s.tobytes() for s in shingle_sets(batch.column(0))]
        rows = [pa.array([xxhash.xxh3_128_digest(x) for x in data], pa.binary()), pa.array([len(x) // 8 for x in data], pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, schema=schema)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and salt, the hub's own row (no cls) first; gives the overlap of each member with its hub."""
    lean_memory()
    schema = pa.schema([("hub", pa.binary()), ("cls", pa.binary()), ("common", pa.int64()), ("whole", pa.int64())])
    hub, own = None, np.zeros(0, _U)
    for batch in batches:
        out = []
        for h, c, data in zip(*(batch.column(k).to_pylist() for k in ("hub", "cls", "shingles"))):
            s = np.frombuffer(data, _U)
            if c is None:
                hub, own = h, s
            elif h == hub:
                n = _common(own, s)
                out.append((h, c, n, len(own) + len(s) - n))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, schema.types)], schema=schema)


def block_links(sets: list[np.ndarray], roots: list[bytes], sides: list[int], link: int = LINK) -> list[tuple[int, int]]:
    """Pairs (i, j) of one block or of two (side 0 and 1) that are similar enough, enough of them to join what they link.

    All pairs of different roots are counted through an inverted index of the block; a pair whose classes earlier pairs
    have already joined is left out.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    counts = np.diff(np.r_[starts, len(flat)])
    code = np.repeat(np.arange(len(starts)), counts)
    shared = counts[code] > 1
    owner_s, code_s = owner[shared], code[shared]
    postings = np.split(owner, starts[1:])
    by_owner = np.argsort(owner_s, kind="stable")
    codes_of = np.split(code_s[by_owner], np.searchsorted(owner_s[by_owner], np.arange(1, n)))
    names = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    parent = np.array([names[r] for r in roots])
    side = np.array(sides)
    two = side.min() != side.max()
    links = []
    for i in range(n):
        if 100 * len(codes_of[i]) < link * sizes[i] or (two and side[i]):
            continue
        common = np.bincount(np.concatenate([postings[c] for c in codes_of[i].tolist()]), minlength=n)
        near = np.flatnonzero((100 * common >= link * (sizes + sizes[i] - common)) & (parent != parent[i]) & ((side != side[i]) if two else True))
        for j in near.tolist():
            if parent[j] != parent[i]:
                parent[parent == parent[j]] = parent[i]
                links.append((i, j))
    return links


def _in_block(table: pa.Table, link: int) -> pa.Table:
    sets = [np.frombuffer(x, _U) for x in table["shingles"].to_pylist()]
    names = table["cls"].to_pylist()
    pairs = block_links(sets, table["root"].to_pylist(), table["side"].to_pylist(), link)
    return pa.table({"u": pa.array([names[i] for i, _ in pairs], pa.binary()), "v": pa.array([names[j] for _, j in pairs], pa.binary())})


def compare_with_hubs(edges: DataFrame, sets: DataFrame, few: bool = False) -> DataFrame:
    """(hub, cls, common, whole) for ``edges(hub, cls)``.  A hub with many members is dealt to several tasks.

    ``few`` edges go to the sets by broadcast, so that only the sets compared are dealt out, and those once for each comparison.
    """
    small = F.broadcast if few else lambda rows: rows
    shares = edges.groupBy("hub").agg((F.count("*") / HUB_SHARE).cast("long").alias("shares"))
    asked = edges.join(shares, "hub").withColumn("salt", F.expr("pmod(xxhash64(cls), shares + 1)"))
    members = small(asked.select("hub", "salt", "cls")).join(sets.select("cls", "shingles"), "cls")
    hubs = small(shares).join(sets.select(F.col("cls").alias("hub"), "shingles"), "hub").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), "shares")))
    rows = members.select("hub", "salt", "cls", "shingles").unionByName(hubs.select("hub", "salt", F.lit(None).cast("binary").alias("cls"), "shingles"))
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("cls").asc_nulls_first())
    return rows.select("hub", "cls", "shingles").mapInArrow(_against_hub, "hub binary, cls binary, common long, whole long")


def sets_of_classes(source: DataFrame, classes: DataFrame, ids: DataFrame, space: Workspace) -> DataFrame:
    """(cls, n, shingles) of the classes in ``ids(cls)``, from ``source(doc_id, text)`` and ``classes(cls, first_id)``.

    The first row of a class may repeat its id with other texts, so the class is computed anew and checked.
    """
    texts, seen = space.keep_seen(classes.join(ids, "cls", "left_semi").select(F.col("first_id").alias("id")).distinct(), F.count(F.lit(1)).alias("n"))
    # Few ids go to the texts, many meet them by a shuffle.
    texts = F.broadcast(texts) if seen["n"] <= FEW_IDS else texts
    found = source.join(texts, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text").mapInArrow(_sets, "cls binary, n long, shingles binary")
    return space.keep(found.join(ids, "cls", "left_semi").dropDuplicates(["cls"]))


def components_of_both(one: DataFrame, two: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(node, root) of two tables of links (u, v), each by itself, found in the same rounds: a byte before the names keeps them apart."""
    marks = [F.lit(bytes([k])) for k in range(2)]
    edges = [rows.select(F.concat(mark, "u").alias("u"), F.concat(mark, "v").alias("v")) for mark, rows in zip(marks, (one, two))]
    every = space.keep(connected_components(edges[0].unionByName(edges[1]), space))
    name = lambda c: F.expr(f"substring({c}, 2)").alias(c)
    found = [every.where(F.substring("node", 1, 1) == mark).select(name("node"), name("root")) for mark in marks]
    return found[0], found[1]


def near_dup_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link: int = LINK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id that links reach), kept (doc_id = component_id).

    Sets link that share ``link`` per cent of their union.  Null and word-free texts have the empty set and link with nothing:
    their component is their own doc_id.  Rows that repeat a doc_id are documents of their own and share the verdict of that id.  A row without doc_id links like any
    other, takes the least id of its component, and is kept only if no row of it has an id.  An empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    return _components(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "long", link)


def _components(source: DataFrame, id_type: str, link: int) -> DataFrame:
    """``near_dup_components`` of (doc_id, text), with ids of any type that has an order."""
    spark = source.sparkSession
    small_batches(spark)
    space = Workspace(spark, "near-dups")
    n_halves = halves_for(link)
    signed = space.keep(source.mapInArrow(lambda batches: _sign(batches, n_halves), f"doc_id {id_type}, n_shingles long, cls binary, halves array<long>"))
    classes = space.keep(signed.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"), F.first("halves").alias("halves")))

    # Half keys that two classes share, then tables over those: a class with none in either collection meets nobody.
    halves = classes.select("cls", F.posexplode("halves").alias("at", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    side = lambda low: F.collect_set(F.when((F.col("at") >= low) & (F.col("at") < low + n_halves), F.struct((F.col("at") - low).alias("at"), "half")))
    halves = halves.join(shared, "half").groupBy("cls").agg(F.sum("n").alias("met"), side(0).alias("a"), side(n_halves).alias("b"))
    halves = space.keep(halves.where("size(a) > 0 AND size(b) > 0"))

    def tables_of(rows: DataFrame, low: int, high: int) -> DataFrame:
        """(key, met, cls, root) of the tables whose second half key has a number ``low`` to ``high`` - 1 places after the first's, around the end."""
        pairs = rows.select("met", "cls", "root", "b", F.explode("a").alias("x")).select("met", "cls", "root", "x", F.explode("b").alias("y"))
        pairs = pairs.where(F.expr(f"pmod(y.at - x.at, {n_halves})").between(low, high - 1))
        return pairs.select(F.xxhash64("x.half", "y.half").alias("key"), "met", "cls", "root")

    def met(rows: DataFrame) -> DataFrame:
        """(key, met, cls, root, hub), without the hub's own row, of the buckets in which two roots meet."""
        # The class with the most common half keys is the hub: near copies then share few hubs.
        # Of tables whose buckets hold the same classes one is enough.
        marks = [F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")]
        hubs = rows.groupBy("key").agg(F.max(F.struct("met", "cls")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *marks).where("low <> high")
        hubs = hubs.groupBy("n", "x", "y").agg(F.min(F.struct("key", F.col("hub.cls").alias("hub"))).alias("one")).select("one.key", "one.hub")
        return rows.join(hubs, "key").where("cls <> hub")

    def sets_of(ids: DataFrame) -> DataFrame:
        return sets_of_classes(source, classes, ids, space)

    def classes_in(rows: DataFrame) -> DataFrame:
        return rows.select("cls").unionByName(rows.select(F.col("hub").alias("cls"))).distinct()

    def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    def compare(rows: DataFrame, sets: DataFrame, seen: list[DataFrame]) -> DataFrame:
        """Compares what was not compared before, adds it to ``seen``; gives (key, met, cls) of the rows that are far from their hub."""
        edges = rows.select("hub", "cls").distinct()
        for before in seen:
            edges = edges.join(before.select("hub", "cls"), ["hub", "cls"], "left_anti")
        edges, kept = space.keep_seen(edges, F.count(F.lit(1)).alias("n"))
        seen.append(space.keep(compare_with_hubs(edges, sets, kept["n"] <= FEW_IDS)))
        far = reduce(DataFrame.unionByName, seen).where(f"100 * common < {FAR} * whole").select("hub", "cls")
        rest = space.keep(rows.join(far, ["hub", "cls"], "left_semi").select("key", "met", "cls"))
        space.drop(rows)
        return rest

    def alike(compared: DataFrame, least: int) -> DataFrame:
        """(u, v): hubs and classes that share ``least`` per cent of their union."""
        return compared.where(f"100 * common >= {least} * whole").select(F.col("hub").alias("u"), F.col("cls").alias("v"))

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        """The components of ``roots``, whose links need not be looked at again, as more links join them."""
        return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links), space)

    # Each table is looked at once, and what the first ones link need not meet again in the others.
    first_tables, seen = math.ceil(n_halves * FIRST), []
    first = space.keep(met(tables_of(halves.withColumn("root", F.col("cls")), 0, first_tables)))
    first_ids = space.keep(classes_in(first))
    first_sets = sets_of(first_ids)
    first_rest = compare(first, first_sets, seen)

    # Classes that are near each other through hubs are one cluster; a small one is a group that is compared as a whole in the end, so
    # buckets within it are done.  In larger ones only what is linked is.
    near, roots = components_of_both(alike(seen[0], FAR), alike(seen[0], link), space)
    clusters = near.join(first_sets.select(F.col("cls").alias("node"), "n"), "node")
    small = clusters.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") <= CLUSTER_SHINGLES)
    clusters = space.keep(clusters.join(small, "root").select("node", "root"))

    def settled(roots: DataFrame) -> DataFrame:
        """(node, root): the cluster of a class, or the component of links if it is in no small cluster."""
        return clusters.unionByName(roots.select("node", "root").join(clusters.select("node"), "node", "left_anti"))

    buckets = space.keep(met(tables_of(with_roots(halves, settled(roots)), first_tables, n_halves)))
    sets = first_sets.unionByName(sets_of(space.keep(classes_in(buckets).join(first_ids, "cls", "left_anti"))))
    rest = first_rest.unionByName(compare(buckets, sets, seen))
    for turn in range(ROUNDS):
        roots = space.keep(joined(roots, alike(seen[-1], link)))
        buckets = space.keep(met(with_roots(rest, settled(roots))))
        if turn == ROUNDS - 1 or buckets.isEmpty():
            break
        rest = compare(buckets, sets, seen)
    every = reduce(DataFrame.unionByName, seen)

    # Balls around hubs of one component overlap much, so they are one group.
    root_of = roots.select(F.col("node").alias("hub"), F.col("root").alias("gid"))
    groups = every.where(f"100 * common >= {FAR - (100 - link)} * whole").join(root_of, "hub", "left").select(F.coalesce("gid", "hub").alias("gid"), "cls").distinct()
    left = buckets.select("key", "cls").unionByName(buckets.select("key", F.col("hub").alias("cls")).distinct())
    left = left.select(F.col("key").cast("string").cast("binary").alias("gid"), "cls")
    groups = groups.unionByName(left).unionByName(clusters.select(F.col("root").alias("gid"), F.col("node").alias("cls"))).distinct().join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups = space.keep(groups.join(sets.select("cls", "n"), "cls"))
    spread = groups.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"), (F.sum("n") / BLOCK_SHINGLES).cast("int").alias("more")).where("low <> high")
    members = groups.join(spread.select("gid", "more"), "gid").withColumn("own", F.expr("cast(pmod(xxhash64(cls), more + 1) as int)"))
    placed = members.withColumn("other", F.explode(F.sequence(F.lit(0), "more"))).select(
        "gid", "cls", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    blocks = placed.join(sets.select("cls", "shingles"), "cls")
    more = space.keep(blocks.groupBy("gid", "i", "j").applyInArrow(lambda table: _in_block(table, link), "u binary, v binary"))
    roots = joined(roots, more)

    named = classes.select("cls", "first_id", "n_docs").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = named.join(least, "root", "left").where("root IS NOT NULL OR n_docs > 1").select("cls", F.coalesce("least_id", "first_id").alias("component_id"))
    named = space.keep(named)
    space.drop_all_but(signed, named)
    out = signed.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept")
    )


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", link: int = LINK) -> DataFrame:
    """The rows of ``docs``, with all their columns: of each group of linked or equal texts the one that stays.

    That is the one of the least id, rows without id last, and of rows that repeat an id the one whose text has the least
    digest.  Rows of one id whose texts are not linked are documents of their own and stay.  Null and word-free texts are linked
    with nothing, so each such row stays.  An empty table gives no rows.
    """
    key = "_near_dup_key"
    while key in docs.columns:
        key += "_"
    words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Binary keys in the order of ids, with the text's digest.
    place = F.lpad(F.hex(F.col(doc_id).cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    named = F.coalesce(F.concat(F.lit("00"), place), F.lit("01" + "0" * 16))
    rows = docs.where(words).withColumn(key, F.unhex(F.concat(named, F.md5(F.col(text)))))
    kept = _components(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "binary", link).where("kept")
    stay = rows.join(kept.select(F.col("doc_id").alias(key)).distinct(), key, "left_semi").dropDuplicates([key]).drop(key)
    return stay.unionByName(docs.where(~words))
