"""Transcript and gene projections, aggregations and numbering.

A transcript row has at least ``seq, strand, tx, cds`` with blocks sorted by start; genes are the rows that share ``gene``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested(blocks: DataFrame, keys: tuple[str, ...] = ("seq", "strand", "tx")) -> DataFrame:
    """One row a transcript from rows of (keys, cds_start, cds_end); blocks sorted by start."""
    return blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("cds_start").alias("start"), F.col("cds_end").alias("end")))).alias("cds"))


def exploded(transcripts: DataFrame) -> DataFrame:
    """One row a block: the other columns, block (from 0), cds_start, cds_end."""
    others = [c for c in transcripts.columns if c != "cds"]
    return transcripts.select(*others, F.posexplode("cds").alias("block", "c")).select(*others, F.col("block").cast("long").alias("block"), F.col("c.start").alias("cds_start"), F.col("c.end").alias("cds_end"))


def non_empty(transcripts: DataFrame) -> DataFrame:
    """What writers and numbering see: transcripts without blocks are skipped."""
    return transcripts.where(F.size("cds") > 0)


def start(cds: Column) -> Column:
    return F.get(cds, F.lit(0))["start"]


def end(cds: Column) -> Column:
    return F.get(cds, F.size(cds) - 1)["end"]


def block_lengths(cds: Column) -> Column:
    return F.transform(cds, lambda c: c["end"] - c["start"])


def coding_length(cds: Column) -> Column:
    return F.aggregate(cds, F.lit(0).cast("long"), lambda a, c: a + c["end"] - c["start"])


def intron_lengths(cds: Column) -> Column:
    """Gaps between successive blocks."""
    return F.transform(introns(cds), lambda i: i["end"] - i["start"])


def introns(cds: Column) -> Column:
    """Blocks between successive blocks."""
    many = F.size(cds) > 1
    pairs = F.zip_with(F.slice(cds, 1, F.greatest(F.size(cds) - 1, F.lit(0))), F.slice(cds, 2, F.greatest(F.size(cds) - 1, F.lit(0))), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))
    return F.when(many, pairs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def extents(transcripts: DataFrame) -> DataFrame:
    """Adds tx_start, tx_end, cds_length and n_blocks."""
    return transcripts.withColumns(
        {"tx_start": start(F.col("cds")), "tx_end": end(F.col("cds")), "cds_length": coding_length(F.col("cds")), "n_blocks": F.size("cds").cast("long")}
    )


def gene_extents(transcripts: DataFrame) -> DataFrame:
    """seq, strand, gene, gene_start, gene_end and n_transcripts over transcripts with blocks."""
    rows = non_empty(transcripts)
    return rows.groupBy("seq", "strand", "gene").agg(F.min(start(F.col("cds"))).alias("gene_start"), F.max(end(F.col("cds"))).alias("gene_end"), F.count("*").alias("n_transcripts"))


def longest(transcripts: DataFrame) -> DataFrame:
    """Each gene's transcript of most coding bases; of equal ones the first by tx."""
    rows = transcripts.withColumn("cds_length", coding_length(F.col("cds")))
    best = F.max_by(F.struct(*rows.columns), F.struct("cds_length", -F.col("tx")))
    return rows.groupBy("gene").agg(best.alias("t")).select("t.*")


def frames(blocks: DataFrame) -> DataFrame:
    """Adds the reading frame of each block: bases to skip to the next codon, counted in strand order."""
    order = F.when(F.col("strand") == "+", F.col("cds_start")).otherwise(-F.col("cds_start"))
    before = Window.partitionBy("seq", "strand", "tx").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("frame", F.pmod(-F.coalesce(F.sum(F.col("cds_end") - F.col("cds_start")).over(before), F.lit(0)), F.lit(3)))


def codon_positions(transcripts: DataFrame) -> DataFrame:
    """Adds one-based closed positions of start and stop codon: three bases at the ends, whatever introns there are."""
    left, right = start(F.col("cds")), end(F.col("cds"))
    plus = F.col("strand") == "+"
    low, high = (left + 1, left + 3), (right - 2, right)
    return transcripts.withColumns(
        {
            "start_codon_start": F.when(plus, low[0]).otherwise(high[0]),
            "start_codon_end": F.when(plus, low[1]).otherwise(high[1]),
            "stop_codon_start": F.when(plus, high[0]).otherwise(low[0]),
            "stop_codon_end": F.when(plus, high[1]).otherwise(low[1]),
        }
    )


def one_based(block: Column) -> Column:
    """(start, end) of a block as one-based closed positions."""
    return F.struct((block["start"] + 1).alias("start"), block["end"].alias("end"))


def numbered(transcripts: DataFrame, first_gene_id: int = 1, order: tuple[str, ...] = ("seq", "gene_start", "gene")) -> DataFrame:
    """Adds gene_id (dense, from ``first_gene_id``, over genes with blocks in ``order``) and transcript_id (from 1 in a gene).

    Genes are counted for each sequence; offsets are sums over the few sequences, so no task sees all genes.
    """
    rows = non_empty(transcripts)
    genes = gene_extents(rows)
    within = Window.partitionBy("seq").orderBy(*order[1:])
    sizes = genes.groupBy("seq").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = genes.withColumn("place", F.row_number().over(within)).join(offsets.select("seq", "before"), "seq")
    ids = ids.select("seq", "strand", "gene", (F.col("place") + F.col("before") + (first_gene_id - 1)).cast("long").alias("gene_id"))
    own = Window.partitionBy("seq", "strand", "gene").orderBy("tx")
    return rows.join(ids, ["seq", "strand", "gene"]).withColumn("transcript_id", F.row_number().over(own).cast("long"))


def display_name(name: Column, pattern: str, **values: Column) -> Column:
    """The explicit name, else ``pattern`` with its ``{fields}`` filled in."""
    parts = [values[p[1:-1]].cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", pattern) if p]
    return F.coalesce(name, F.concat(*parts))


def named(rows: DataFrame, gene_pattern: str = "g{gene_id}", transcript_pattern: str = "g{gene_id}_t{transcript_id}") -> DataFrame:
    """Fills gene_name and tx_name of numbered transcripts."""
    have = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("gene_name", "tx_name")}
    ids = {"gene_id": F.col("gene_id"), "transcript_id": F.col("transcript_id")}
    return rows.withColumns({"gene_name": display_name(have["gene_name"], gene_pattern, **ids), "tx_name": display_name(have["tx_name"], transcript_pattern, **ids)})


def single_transcript_genes(transcripts: DataFrame) -> DataFrame:
    """Each transcript as a gene of its own."""
    return transcripts.withColumn("gene", F.col("tx"))


def appended(transcripts: DataFrame, more: DataFrame) -> DataFrame:
    """Both annotations, those of ``more`` after the others; ``gene_ord`` goes on."""
    last = transcripts.agg(F.coalesce(F.max("gene_ord") + 1, F.lit(0).cast("long")).alias("_next"))
    return transcripts.unionByName(more.crossJoin(F.broadcast(last)).withColumn("gene_ord", F.col("gene_ord") + F.col("_next")).drop("_next"))


def of_sequence(transcripts: DataFrame, seq: str | int) -> DataFrame:
    """Transcripts of one sequence, by name or by its place among the sequences in order of ``seq_ord``; unknown ones give none."""
    if isinstance(seq, str):
        return transcripts.where(F.col("seq") == seq)
    ranks = transcripts.select("seq", "seq_ord").distinct().orderBy("seq_ord").offset(seq).limit(1).select("seq")
    return transcripts.join(F.broadcast(ranks), "seq", "left_semi")
