"""Comparison of annotations with a reference at six levels, all annotations of ``annotation`` in one plan.

Matching is on one sequence and strand.  base: bases of merged blocks; exon and intron: distinct pairs of ends; intron chain:
all introns of a transcript of several blocks; transcript: the chain and, within ``tolerance``, the outer ends (both ends for a
single block); locus: clusters of overlapping transcripts, matched if a transcript of theirs is.  ``tolerance`` relaxes outer
ends of outer exons only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Workspace
from .histograms import f1
from .intervals import interval_overlap_join, islands, merged, overlap_semi_join
from .sequences import chunk_table, with_letters
from .transcripts import coding_length, end, exploded, introns, non_empty, start

PLACE = ["seq", "strand"]


def _tally(ref_total: DataFrame, query_total: DataFrame, ref_hit: DataFrame, query_hit: DataFrame, level: str) -> DataFrame:
    """One row an annotation: counts as sensitivity and precision, rounded to three places."""
    rows = query_total.join(query_hit, "annotation", "left").join(ref_hit, "annotation", "left").crossJoin(F.broadcast(ref_total))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.coalesce(a, F.lit(0)) / F.col(b)).otherwise(0.0), 3)
    rows = rows.select("annotation", F.lit(level).alias("level"), ratio("ref_hit", "ref_total").alias("sensitivity"), ratio("query_hit", "query_total").alias("precision"))
    return rows.withColumn("f1", F.round(f1(F.col("sensitivity"), F.col("precision")), 3))


def _counted(ref: DataFrame, query: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Level of features that match by equal keys; the features of both sides are distinct."""
    hit = query.join(ref, keys).groupBy("annotation").agg(F.count("*").alias("query_hit"), F.count("*").alias("ref_hit"))
    return _tally(ref.agg(F.count("*").alias("ref_total")), query.groupBy("annotation").agg(F.count("*").alias("query_total")), hit.select("annotation", "ref_hit"), hit.select("annotation", "query_hit"), level)


def compare_exons(query: DataFrame, reference: DataFrame) -> DataFrame:
    return _exon_level(_exon_spans(query, ["annotation"]), _exon_spans(reference, []))


def _exon_level(query: DataFrame, reference: DataFrame) -> DataFrame:
    return _counted(reference, query, [*PLACE, "low", "high"], "exon")


def _intron_rows(rows: DataFrame, more: list[str]) -> DataFrame:
    return rows.select(*more, *PLACE, F.explode(introns(F.col("cds"))).alias("i")).select(*more, *PLACE, "i.start", "i.end").distinct()


def compare_introns(query: DataFrame, reference: DataFrame) -> DataFrame:
    return _counted(_intron_rows(reference, []), _intron_rows(query, ["annotation"]), [*PLACE, "start", "end"], "intron")


def _chains(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chain", introns(F.col("cds")))


def compare_chains(query: DataFrame, reference: DataFrame) -> DataFrame:
    """Transcripts of several blocks; repeated chains are one."""
    keys = [*PLACE, "chain"]
    several = F.size("chain") > 0
    return _counted(_chains(reference).where(several).select(*keys).distinct(), _chains(query).where(several).select("annotation", *keys).distinct(), keys, "intron_chain")


def _structures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, strand, chain, low, high, tx, n): transcripts of one chain and outer ends as one row, with the least tx and their number."""
    cut = [introns(F.col("cds")).alias("chain"), start(F.col("cds")).alias("low"), end(F.col("cds")).alias("high")]
    return non_empty(rows).select(*keys, *PLACE, "tx", *cut).groupBy(*keys, *PLACE, "chain", "low", "high").agg(F.min("tx").alias("tx"), F.count("*").alias("n"))


def _structure_matches(q: DataFrame, r: DataFrame, tolerance: int) -> DataFrame:
    """(annotation, seq, strand, tx, low, n, ref_tx, ref_low, ref_n) of structures with the same chain and outer ends within the tolerance."""
    r = r.withColumnsRenamed({c: f"ref_{c}" for c in ("tx", "low", "high", "n")})
    # Equal starts, or starts of neighbouring steps of the tolerance: an equi-join also for single blocks, whose chains are all empty.
    step = 2 * tolerance + 1
    q = q.withColumn("_at", F.floor(F.col("low") / step))
    r = r.withColumn("_at", F.explode(F.array_distinct(F.array(*(F.floor((F.col("ref_low") + d) / step) for d in (-tolerance, tolerance))))))
    near = (F.abs(F.col("low") - F.col("ref_low")) <= tolerance) & (F.abs(F.col("high") - F.col("ref_high")) <= tolerance)
    return q.join(r, [*PLACE, "chain", "_at"]).where(near).select("annotation", *PLACE, "tx", "low", "n", "ref_tx", "ref_low", "ref_n")


def _matched(query: DataFrame, reference: DataFrame, tolerance: int, space: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, r = space.keep(_structures(query, ["annotation"])), space.keep(_structures(reference, []))
    return q, r, space.keep(_structure_matches(q, r, tolerance))


def compare_transcripts(query: DataFrame, reference: DataFrame, tolerance: int = 0) -> DataFrame:
    return _transcript_level(*_matched(query, reference, tolerance, Workspace(query.sparkSession, "compare")))


def _transcript_level(q: DataFrame, r: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each transcript counts, those of one structure together."""
    hit = lambda tx, n, name: pairs.select("annotation", tx, n).distinct().groupBy("annotation").agg(F.sum(n).alias(name))
    return _tally(r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ref_total")), q.groupBy("annotation").agg(F.sum("n").alias("query_total")), hit("ref_tx", "ref_n", "ref_hit"), hit("tx", "n", "query_hit"), "transcript")


def compare_bases(query: DataFrame, reference: DataFrame) -> DataFrame:
    return _base_level(_exon_spans(query, ["annotation"]), _exon_spans(reference, []))


def _base_level(query: DataFrame, reference: DataFrame) -> DataFrame:
    """Of blocks that begin together only the longest counts for their union."""
    space = Workspace(query.sparkSession, "compare")
    longest = lambda rows, keys: rows.groupBy(*keys, "low").agg(F.max("high").alias("high"))
    q, r = (merged(space.keep(longest(rows, keys)), keys) for rows, keys in ((query, ["annotation", *PLACE]), (reference, PLACE)))
    q, r = space.keep(q), space.keep(r.withColumnsRenamed({"low": "ref_low", "high": "ref_high"}))
    common = interval_overlap_join(q, r, ("low", "high"), ("ref_low", "ref_high"), tuple(PLACE))
    size = F.sum(F.least("high", "ref_high") - F.greatest("low", "ref_low"))
    hits = common.groupBy("annotation").agg(size.alias("query_hit"), size.alias("ref_hit"))
    return _tally(
        r.agg(F.sum(F.col("ref_high") - F.col("ref_low")).alias("ref_total")), q.groupBy("annotation").agg(F.sum(F.col("high") - F.col("low")).alias("query_total")),
        hits.select("annotation", "ref_hit"), hits.select("annotation", "query_hit"), "base",
    )


def loci(transcripts: DataFrame, keys: list[str]) -> DataFrame:
    """Transcripts with the locus they belong to: its start within (keys, seq, strand)."""
    rows = non_empty(transcripts).select(*keys, *PLACE, "tx", start(F.col("cds")).alias("low"), end(F.col("cds")).alias("high"))
    return islands(rows, [*keys, *PLACE], "low", "high", False).withColumnRenamed("_island", "locus")


def compare_loci(query: DataFrame, reference: DataFrame, tolerance: int = 0) -> DataFrame:
    return _locus_level(*_matched(query, reference, tolerance, Workspace(query.sparkSession, "compare")))


def _locus_level(q: DataFrame, r: DataFrame, pairs: DataFrame) -> DataFrame:
    """Transcripts that begin together are of one locus, so their starts stand for them."""
    space, total = Workspace(q.sparkSession, "compare"), F.count_distinct(F.struct(*PLACE, "locus"))

    def starts(rows: DataFrame, keys: list[str]) -> DataFrame:
        reach = space.keep(rows.groupBy(*keys, "low").agg(F.max("high").alias("high")))
        return space.keep(islands(reach, keys, "low", "high", False).withColumnRenamed("_island", "locus").select(*keys, "low", "locus"))

    q, r = starts(q, ["annotation", *PLACE]), starts(r, PLACE)
    hit = lambda rows, low, keys, name: rows.join(pairs.select("annotation", *PLACE, F.col(low).alias("low")).distinct(), keys).groupBy("annotation").agg(total.alias(name))
    q_hits, r_hits = hit(q, "low", ["annotation", *PLACE, "low"], "query_hit"), hit(r, "ref_low", [*PLACE, "low"], "ref_hit")
    return _tally(r.agg(total.alias("ref_total")), q.groupBy("annotation").agg(total.alias("query_total")), r_hits, q_hits, "locus")


def compare(query: DataFrame, reference: DataFrame, tolerance: int = 0) -> DataFrame:
    """(annotation, level, sensitivity, precision, f1) at all six levels.  Both sides are written once and reread by the levels."""
    space = Workspace(query.sparkSession, "compare")
    query, reference = space.keep(query.select("annotation", *PLACE, "tx", "cds")), space.keep(reference.select(*PLACE, "tx", "cds"))
    exons = space.keep(_exon_spans(query, ["annotation"])), space.keep(_exon_spans(reference, []))
    matched = _matched(query, reference, tolerance, space)
    parts = [_base_level(*exons), _exon_level(*exons), compare_introns(query, reference), compare_chains(query, reference)]
    return reduce(DataFrame.unionByName, [*parts, _transcript_level(*matched), _locus_level(*matched)])


# Class codes from the best to the last, and what they say of a query and a reference transcript.
CLASS_CODES = (
    ("=", "the same introns, outer ends within the tolerance"),
    ("c", "contained in the reference, with its introns there"),
    ("k", "contains the reference, with the query's introns there"),
    ("m", "blocks over whole introns of the reference, whose other introns are the query's"),
    ("n", "blocks over whole introns of the reference, not all of the others are the query's"),
    ("j", "an intron in common"),
    ("e", "one block that reaches from a block of the reference ten bases into an intron"),
    ("o", "blocks overlap"),
    ("s", "an intron in common, on the other strand"),
    ("x", "blocks overlap, on the other strand"),
    ("i", "within an intron of the reference"),
    ("y", "the reference lies within an intron of the query"),
    ("p", "no more than 2,000 bases from the reference, on its strand"),
    ("r", "none of these, and half of the query's bases are masked as repeats"),
    ("u", "none of these"),
)
#: Bases that a block must reach into an intron for code e, the distance for code p, and the share of masked bases for code r.
INTO_INTRON, NEAR_BY, MASKED = 10, 2000, 0.5
CODES = [code for code, _ in CLASS_CODES]


def _introns_within(c: str, low: str, high: str) -> Column:
    return F.filter(c, lambda i: (i["start"] < F.col(high)) & (F.col(low) < i["end"]))


def _some(a: str, b: str, test) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: test(x, y)))


def _pair_codes(pairs: DataFrame, tolerance: int) -> Column:
    """Rank of the code of a query (low, high, cds, gaps, strand) and a reference (the same names with ref_)."""
    common = F.least("high", "ref_high") - F.greatest("low", "ref_low")
    own = F.col("strand") == F.col("ref_strand")
    over = _some("cds", "ref_cds", lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    junction = F.arrays_overlap("gaps", "ref_gaps")
    same_outer = (F.abs(F.col("low") - F.col("ref_low")) <= tolerance) & (F.abs(F.col("high") - F.col("ref_high")) <= tolerance)
    into = _some("cds", "ref_gaps", lambda x, y: F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]) >= INTO_INTRON)
    spanned = lambda g: F.exists("cds", lambda x: (x["start"] <= g["start"]) & (g["end"] <= x["end"]))
    retained = F.exists("ref_gaps", spanned)
    settled = F.forall("ref_gaps", lambda g: F.array_contains("gaps", g) | spanned(g)) & F.forall("gaps", lambda g: F.array_contains("ref_gaps", g))
    tests = {
        "=": own & (F.col("gaps") == F.col("ref_gaps")) & same_outer,
        "c": own & (F.col("low") >= F.col("ref_low")) & (F.col("high") <= F.col("ref_high")) & (_introns_within("ref_gaps", "low", "high") == F.col("gaps")),
        "k": own & (F.col("low") <= F.col("ref_low")) & (F.col("high") >= F.col("ref_high")) & (_introns_within("gaps", "ref_low", "ref_high") == F.col("ref_gaps")),
        "m": own & retained & settled,
        "n": own & retained,
        "j": own & junction,
        "e": own & (F.size("gaps") == 0) & over & into,
        "o": own & over,
        "s": ~own & junction,
        "x": ~own & over,
        "i": F.exists("ref_gaps", lambda g: (g["start"] <= F.col("low")) & (F.col("high") <= g["end"])),
        "y": F.exists("gaps", lambda g: (g["start"] <= F.col("ref_low")) & (F.col("ref_high") <= g["end"])),
        "p": own & (common <= 0),
    }
    return F.coalesce(*(F.when(tests[code], F.lit(k)) for k, code in enumerate(CODES) if code in tests), F.lit(len(CODES) - 1))


def masked_bases(transcripts: DataFrame, sequences: DataFrame, key: str = "tx") -> DataFrame:
    """(key, masked): coding bases in lower case; what lies beyond its sequence is not masked.  Letters come from chunks."""
    ranges = exploded(transcripts).select("seq", key, F.col("cds_start").alias("start"), F.col("cds_end").alias("end"))
    pieces = with_letters(ranges, chunk_table(sequences))
    return pieces.groupBy(key).agg(F.sum(F.length(F.regexp_replace("letters", "[^a-z]", ""))).cast("long").alias("masked"))


def class_codes(query: DataFrame, reference: DataFrame, tolerance: int = 0, sequences: DataFrame | None = None) -> DataFrame:
    """(ref_gene_id, ref_id, class_code, qry_gene_id, qry_id, num_exons, FPKM, TPM, cov, len, major_iso_id, ref_match_len): one row
    a query transcript, with its best reference transcript.

    Of several references of one code the one with most overlap of spans counts, then the least ref_id.  The major isoform of a
    gene is its longest transcript.  Code r needs ``sequences``.  Expression values are not known and are 0.

    Transcripts of one structure are compared once, under the least of their ids.  The best codes are found without forming all
    pairs: = by introns and outer ends, the others down to j by common introns, blocks within blocks and introns within blocks.
    Who has one of these is taken out; of the others only those without any touching block on their strand meet all that is near.
    """
    space = Workspace(query.sparkSession, "class-codes")
    cut = [introns(F.col("cds")).alias("gaps"), start(F.col("cds")).alias("low"), end(F.col("cds")).alias("high")]
    same = Window.partitionBy("seq", "strand", "cds")
    q = space.keep(non_empty(query).select("seq", "strand", "tx", "gene", "cds", F.min("tx").over(same).alias("shape")))
    named = ["strand", "cds", "gaps", "low", "high"]
    r = non_empty(reference).groupBy("seq", "strand", "cds").agg(F.min(F.struct(F.col("tx").alias("ref_id"), F.col("gene").alias("ref_gene_id"))).alias("ref"))
    r = space.keep(r.select("seq", "ref.*", *named[:2]))
    known = r.select("ref_id", "ref_gene_id", coding_length(F.col("cds")).alias("ref_match_len"))
    r = r.select("seq", "ref_id", "strand", "cds", *cut).select("seq", "ref_id", *(F.col(c).alias(f"ref_{c}") for c in named))
    shapes = q.where("tx = shape").select("shape", "seq", "strand", "cds", *cut)

    # Equal starts, or starts of neighbouring steps of the tolerance, make this an equi-join.
    step = 2 * tolerance + 1
    ends = r.drop("ref_cds").select("*", F.explode(F.array_distinct(F.array(*(F.floor((F.col("ref_low") + d) / step) for d in (-tolerance, tolerance))))).alias("_at"))
    chains = shapes.drop("cds").withColumn("_at", F.floor(F.col("low") / step)).join(ends.withColumnsRenamed({"ref_strand": "strand", "ref_gaps": "gaps"}), ["seq", "strand", "gaps", "_at"])
    near_ends = (F.abs(F.col("low") - F.col("ref_low")) <= tolerance) & (F.abs(F.col("high") - F.col("ref_high")) <= tolerance)
    equal = space.keep(chains.where(near_ends).groupBy("shape").agg(_best(F.lit(0))))

    rest = space.keep(shapes.where("high > low").join(equal.select("shape"), "shape", "left_anti"))
    settled = space.keep(_settled(rest, r, tolerance, space))
    rest = space.keep(rest.join(settled.select("shape"), "shape", "left_anti"))
    touching = space.keep(_touching(rest, r))
    rest = space.keep(rest.join(touching.select("shape"), "shape", "left_anti"))
    near = r.withColumns({"_a": F.col("ref_low") - NEAR_BY, "_b": F.col("ref_high") + NEAR_BY})
    pairs = interval_overlap_join(rest, near, ("low", "high"), ("_a", "_b"), ("seq",), width=NEAR_BY)
    other = pairs.groupBy("shape").agg(_best(_pair_codes(pairs, tolerance)))

    best = reduce(DataFrame.unionByName, [equal, settled, touching, other]).select("shape", "best.rank", "best.ref_id")
    major = q.groupBy("gene").agg(F.max_by("tx", F.struct(coding_length(F.col("cds")), -F.col("tx"))).alias("major_iso_id"))
    rows = q.select("tx", "gene", "shape", F.size("cds").cast("long").alias("num_exons"), coding_length(F.col("cds")).alias("len")).join(best, "shape", "left")
    rows = space.keep(rows.withColumn("rank", F.coalesce("rank", F.lit(CODES.index("u")))))
    rank = F.col("rank")
    if sequences is not None:
        alone = masked_bases(q.join(rows.where(rank == CODES.index("u")).select("tx"), "tx", "left_semi").select("seq", "tx", "cds"), sequences)
        rows = rows.join(alone, "tx", "left")
        rank = F.when((rank == CODES.index("u")) & (F.col("masked") >= MASKED * F.col("len")), CODES.index("r")).otherwise(rank)
    code = F.element_at(F.array(*map(F.lit, CODES)), rank + 1)
    matched = rank < CODES.index("r")
    rows = rows.withColumns({"class_code": code, "ref_id": F.when(matched, F.col("ref_id"))}).join(known, "ref_id", "left").join(major, "gene")
    zero = F.lit(0.0)
    return rows.select(
        "ref_gene_id", "ref_id", "class_code", F.col("gene").alias("qry_gene_id"), F.col("tx").alias("qry_id"),
        "num_exons", zero.alias("FPKM"), zero.alias("TPM"), zero.alias("cov"), "len", "major_iso_id", "ref_match_len",
    )


def _best(rank: Column, common: Column | None = None) -> Column:
    """The best rank, of equal ones most in common, then the least reference."""
    common = F.least("high", "ref_high") - F.greatest("low", "ref_low") if common is None else common
    return F.min(F.struct(rank.alias("rank"), (-common).cast("long").alias("_c"), "ref_id")).alias("best")


#: Bins in which blocks meet.
BLOCK_BIN = 128


def _settled(shapes: DataFrame, references: DataFrame, tolerance: int, space: Workspace) -> DataFrame:
    """(shape, best) of those with a code from c to j.

    A query of several blocks has c, and a reference of several blocks gives k, only by introns that both have; j is one such, and
    m and n need an intron of the reference within a block.  These pairs are looked at whole.  What is left of c and k is a query
    within a block of the reference, and a reference of one block within a block of the query.
    """
    place = ["seq", "strand"]
    gaps = references.select("seq", F.col("ref_strand").alias("strand"), "ref_id", F.explode("ref_gaps").alias("g")).select(*place, "ref_id", "g.*")
    blocks = shapes.select(*place, "shape", F.explode("cds").alias("b")).select(*place, "shape", F.col("b.start").alias("low"), F.col("b.end").alias("high"))
    common = shapes.select(*place, "shape", F.explode("gaps").alias("g")).select(*place, "shape", "g.*").join(gaps, [*place, "start", "end"]).select("shape", "ref_id")
    # An intron is no longer than a block that it lies in: both go by powers of two, blocks to all that introns have up to their own.
    power = lambda size: F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")
    sized = gaps.withColumn("_size", power(F.col("end") - F.col("start")))
    least = sized.agg(F.min("_size").alias("_least"))
    asked = blocks.withColumn("_size", power(F.col("high") - F.col("low"))).crossJoin(F.broadcast(least)).where("_size >= _least")
    asked = asked.select(*place, "shape", "low", "high", F.explode(F.sequence("_least", "_size")).alias("_size"))
    asked = asked.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / BLOCK_BIN), F.floor(F.col("high") / BLOCK_BIN))))
    held = sized.withColumn("_bin", F.floor(F.col("start") / BLOCK_BIN)).join(asked, [*place, "_size", "_bin"]).where("low <= start AND end <= high").select("shape", "ref_id")
    ids = space.keep(common.unionByName(held).distinct())
    pairs = ids.join(shapes, "shape").join(references.drop("seq"), "ref_id")
    whole = pairs.groupBy("shape").agg(_best(_pair_codes(pairs, tolerance)))

    one = space.keep(shapes.where(F.size("cds") == 1).select(*place, "shape", "low", "high"))
    ref_blocks = references.select("seq", F.col("ref_strand").alias("strand"), "ref_id", F.explode("ref_cds").alias("b")).select(*place, "ref_id", F.col("b.start").alias("ref_low"), F.col("b.end").alias("ref_high"))
    within = interval_overlap_join(one, ref_blocks, ("low", "high"), ("ref_low", "ref_high"), (*place,), BLOCK_BIN).where("ref_low <= low AND high <= ref_high")
    within = within.groupBy("shape").agg(_best(F.lit(CODES.index("c"))))

    ref_one = space.keep(references.where(F.size("ref_cds") == 1).select("seq", F.col("ref_strand").alias("strand"), "ref_id", "ref_low", "ref_high", (F.col("ref_high") + 1).alias("_to")))
    holding = interval_overlap_join(blocks.withColumn("_stop", F.col("high") + 1), ref_one, ("low", "_stop"), ("ref_low", "_to"), (*place,), BLOCK_BIN).where("low <= ref_low AND ref_high <= high")
    holding = holding.groupBy("shape").agg(_best(F.lit(CODES.index("k"))))
    return whole.unionByName(within).unionByName(holding).groupBy("shape").agg(F.min("best").alias("best"))


def _touching(shapes: DataFrame, references: DataFrame) -> DataFrame:
    """(shape, best) of those with a block over one of a reference on their strand, code e or o, if no better code is known.

    One block that reaches from any block into any intron also reaches from the block beside that intron.
    """
    place = ["seq", "strand"]
    blocks = shapes.select(*place, "shape", "low", "high", (F.size("cds") == 1).alias("_one"), F.explode("cds").alias("b")).select("*", "b.start", "b.end").drop("b")
    rows = references.select("seq", F.col("ref_strand").alias("strand"), "ref_id", "ref_low", "ref_high", "ref_cds", F.posexplode("ref_cds").alias("_k", "b"))
    rows = rows.select(*place, "ref_id", "ref_low", "ref_high", F.col("b.start").alias("_from"), F.col("b.end").alias("_to"), *(F.get("ref_cds", F.col("_k") + k)[c].alias(n) for k, c, n in ((-1, "end", "_before"), (1, "start", "_after"))))
    pairs = interval_overlap_join(blocks, rows, ("start", "end"), ("_from", "_to"), (*place,), BLOCK_BIN)
    reach = lambda a, b: F.coalesce(F.least("end", b) - F.greatest("start", a) >= INTO_INTRON, F.lit(False))
    left = F.col("_before").isNotNull() & reach("_before", "_from")
    right = F.col("_after").isNotNull() & reach("_to", "_after")
    return pairs.groupBy("shape").agg(_best(F.when(F.col("_one") & (left | right), CODES.index("e")).otherwise(CODES.index("o"))))


def missed_and_novel(query: DataFrame, reference: DataFrame, levels: tuple[str, ...] = ("exon", "locus")) -> DataFrame:
    """(annotation, level, missed, novel) for exons and loci: shares of features of one side that overlap none of the other."""
    space, out = Workspace(query.sparkSession, "missed-and-novel"), []
    for level, features in (("exon", _exon_spans), ("locus", _locus_spans)):
        if level not in levels:
            continue
        q, r = space.keep(features(query, ["annotation"])), space.keep(features(reference, []))
        totals = q.groupBy("annotation").agg(F.count("*").alias("n"))
        known = overlap_semi_join(q, r, PLACE).groupBy("annotation").agg(F.count("*").alias("known"))
        seen = overlap_semi_join(r.crossJoin(F.broadcast(totals.select("annotation"))), q, ["annotation", *PLACE]).groupBy("annotation").agg(F.count("*").alias("seen"))
        rows = totals.join(known, "annotation", "left").join(seen, "annotation", "left").crossJoin(F.broadcast(r.agg(F.count("*").alias("m"))))
        share = lambda a, b: F.round(F.when(F.col(b) > 0, 1 - F.coalesce(a, F.lit(0)) / F.col(b)).otherwise(0.0), 3)
        out.append(rows.select("annotation", F.lit(level).alias("level"), share("seen", "m").alias("missed"), share("known", "n").alias("novel")))
    return reduce(DataFrame.unionByName, out)


def _exon_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    return exploded(rows).select(*keys, *PLACE, F.col("cds_start").alias("low"), F.col("cds_end").alias("high")).distinct()


def _locus_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    return loci(rows, keys).groupBy(*keys, *PLACE, "locus").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("locus")
