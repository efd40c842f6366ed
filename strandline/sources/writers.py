"""Rows of the text formats, and their writers.

Rows are columns of plans; ``write_lines`` writes them in order.  Annotations are numbered and named transcripts (see
``numbered`` and ``named``); transcripts without blocks are not written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import protein
from ..operators.checks import coding_sequences
from ..operators.transcripts import codon_positions, coding_length, end, longest, non_empty, start

ORDER = ("gene_id", "transcript_id", "rank")


def write_lines(rows: DataFrame, path: str, order: tuple[str, ...] = (), column: str = "line", append: bool = False, gzip: bool = False) -> None:
    """Writes a text column; an existing target is refused unless rows are appended."""
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(column).write.mode("append" if append else "errorifexists").option("compression", "gzip" if gzip else "none").text(path)


def fasta_lines(sequences: DataFrame, width: int = 80) -> DataFrame:
    """One record a row, its body wrapped."""
    body = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return sequences.withColumn("line", F.concat(F.lit(">"), "name", F.when(F.length("sequence") > 0, F.concat(F.lit("\n"), body)).otherwise("")))


def write_fasta(sequences: DataFrame, path: str, width: int = 80, gzip: bool = False) -> None:
    write_lines(fasta_lines(sequences, width), path, ("seq_ord",), gzip=gzip)


def genepred_lines(transcripts: DataFrame) -> DataFrame:
    """Ten columns: coding and transcript range are the same, lists end with a comma."""
    rows = non_empty(transcripts)
    low, high = start(F.col("cds")).cast("string"), end(F.col("cds")).cast("string")

    def ends(field: str) -> Column:
        return F.concat(F.array_join(F.transform("cds", lambda c: c[field].cast("string")), ","), F.lit(","))

    return rows.withColumn("line", F.concat_ws("\t", "tx_name", "seq", "strand", low, high, low, high, F.size("cds").cast("string"), ends("start"), ends("end")))


def _blocks_with_frames(transcripts: DataFrame) -> DataFrame:
    """Adds ``parts``: blocks in order with the frame of each, from running sums in strand order."""

    def frames(c: Column, i: Column) -> Column:
        plus = coding_length(F.slice("cds", F.lit(1), i))
        minus = coding_length(F.slice("cds", i + 2, F.greatest(F.size("cds") - i - 1, F.lit(0))))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.pmod(-F.when(F.col("strand") == "+", plus).otherwise(minus), F.lit(3)).alias("frame"))

    return non_empty(transcripts).withColumn("parts", F.transform("cds", frames))


def _line(source: str, feature: Column, low: Column, high: Column, frame: Column, attributes: Column) -> Column:
    return F.concat_ws("\t", "seq", F.lit(source), feature, low.cast("string"), high.cast("string"), F.lit("."), "strand", frame, attributes)


def _gene_rows(transcripts: DataFrame) -> DataFrame:
    keys = ["seq", "strand", "gene_id", "gene_name"]
    return non_empty(transcripts).groupBy(*keys).agg((F.min(start(F.col("cds"))) + 1).alias("low"), F.max(end(F.col("cds"))).alias("high"))


def gtf_lines(transcripts: DataFrame, source: str = "strandline") -> DataFrame:
    """(gene_id, transcript_id, rank, line): gene, transcript, start and stop codon, then block by block CDS, exon and intron."""
    gene_only = F.format_string('gene_id "%s";', "gene_name")
    both = F.format_string('gene_id "%s"; transcript_id "%s";', "gene_name", "tx_name")
    dot = F.lit(".")
    genes = _gene_rows(transcripts).select("gene_id", F.lit(0).cast("long").alias("transcript_id"), F.lit(0).alias("rank"), _line(source, F.lit("gene"), F.col("low"), F.col("high"), dot, gene_only).alias("line"))
    rows = codon_positions(_blocks_with_frames(transcripts))
    cell = lambda name, low, high, frame: F.struct(F.lit(name).alias("f"), low.cast("long").alias("a"), high.cast("long").alias("b"), frame.cast("string").alias("frame"))
    head = F.array(
        cell("transcript", start(F.col("cds")) + 1, end(F.col("cds")), dot),
        cell("start_codon", F.col("start_codon_start"), F.col("start_codon_end"), F.lit("0")),
        cell("stop_codon", F.col("stop_codon_start"), F.col("stop_codon_end"), F.lit("0")),
    )

    def block(p: Column, i: Column) -> Column:
        pair = F.array(cell("CDS", p["start"] + 1, p["end"], p["frame"]), cell("exon", p["start"] + 1, p["end"], p["frame"]))
        return F.when(i + 1 < F.size("parts"), F.concat(pair, F.array(cell("intron", p["end"] + 1, F.get("parts", i + 1)["start"], dot)))).otherwise(pair)

    cells = F.concat(head, F.flatten(F.transform("parts", block)))
    parts = rows.select("seq", "strand", "gene_id", "gene_name", "transcript_id", "tx_name", F.posexplode(cells).alias("rank", "c"))
    return genes.unionByName(parts.select("gene_id", "transcript_id", "rank", _line(source, F.col("c.f"), F.col("c.a"), F.col("c.b"), F.col("c.frame"), both).alias("line")))


def gff3_lines(transcripts: DataFrame, source: str = "strandline", header: bool = True) -> DataFrame:
    """(gene_id, transcript_id, rank, line): gene, mRNA, then block by block CDS and exon, numbered from 1."""
    dot = F.lit(".")
    genes = _gene_rows(transcripts).select(
        "gene_id", F.lit(0).cast("long").alias("transcript_id"), F.lit(0).alias("rank"), _line(source, F.lit("gene"), F.col("low"), F.col("high"), dot, F.format_string("ID=%s;Name=%s", "gene_name", "gene_name")).alias("line")
    )
    rows = _blocks_with_frames(transcripts)
    mrna = rows.select(
        "gene_id", "transcript_id", F.lit(0).alias("rank"),
        _line(source, F.lit("mRNA"), start(F.col("cds")) + 1, end(F.col("cds")), dot, F.format_string("ID=%s;Name=%s;Parent=%s", "tx_name", "tx_name", "gene_name")).alias("line"),
    )
    parts = rows.select("seq", "strand", "gene_id", "transcript_id", "tx_name", F.posexplode("parts").alias("i", "p")).select("*", F.explode(F.array(F.lit("CDS"), F.lit("exon"))).alias("f"))
    attributes = F.format_string("ID=%s.%s.%d;Parent=%s", "tx_name", "f", F.col("i") + 1, "tx_name")
    parts = parts.select("gene_id", "transcript_id", (2 * F.col("i") + F.when(F.col("f") == "CDS", 1).otherwise(2)).alias("rank"), _line(source, F.col("f"), F.col("p.start") + 1, F.col("p.end"), F.col("p.frame").cast("string"), attributes).alias("line"))
    out = genes.unionByName(mrna).unionByName(parts)
    if header:
        first = out.sparkSession.range(1).select(F.lit(None).cast("long").alias("gene_id"), F.lit(0).cast("long").alias("transcript_id"), F.lit(0).alias("rank"), F.lit("##gff-version 3").alias("line"))
        out = first.unionByName(out)
    return out


def record_lines(transcripts: DataFrame, sequences: DataFrame, target: str = "coding", width: int = 60, header: Column | None = None, table: int = 1, skip_empty: bool = True) -> DataFrame:
    """Coding or protein records; the header tells gene, transcript and zero-based range unless another one is given.

    Transcripts without blocks are skipped or, if asked, give records without letters.
    """
    rows = coding_sequences(transcripts, sequences)
    rows = rows.withColumn("sequence", protein(F.col("coding"), table) if target == "protein" else F.col("coding"))
    if not skip_empty:
        rows = rows.unionByName(transcripts.where(F.size("cds") == 0).withColumns({"coding": F.lit(""), "sequence": F.lit("")}))
    low, high = (F.coalesce(x, F.lit(0).cast("long")) for x in (start(F.col("cds")), end(F.col("cds"))))
    usual = F.format_string("%s|%s|%s:%d-%d(%s)", "gene_name", "tx_name", "seq", low, high, "strand")
    return fasta_lines(rows.withColumn("name", usual if header is None else header), width)


def write_records(transcripts: DataFrame, sequences: DataFrame, path: str, target: str = "coding", gzip: bool = False, append: bool = False, **options) -> None:
    """Records of numbered transcripts, in their order."""
    write_lines(record_lines(transcripts, sequences, target, **options), path, ("gene_id", "transcript_id"), append=append, gzip=gzip)


def index_rows(transcripts: DataFrame, single_cover: bool = False) -> DataFrame:
    """Transcripts with tx_start and tx_end, in order of sequence and start; with ``single_cover`` each gene's longest one only."""
    rows = non_empty(transcripts)
    rows = (longest(rows) if single_cover else rows).withColumns({"tx_start": start(F.col("cds")), "tx_end": end(F.col("cds"))})
    return rows.repartitionByRange("seq", "tx_start", "tx").sortWithinPartitions("seq", "tx_start", "tx")


def write_index(transcripts: DataFrame, path: str, single_cover: bool = False) -> None:
    """``index_rows`` in partitions of their sequence: row-group statistics then act as range index."""
    index_rows(transcripts, single_cover).write.partitionBy("seq").parquet(path)


def write_tmap(rows: DataFrame, path: str) -> None:
    """Class codes as a table; ``path`` should differ for each annotation (see ``tmap_paths``)."""
    rows.na.fill("-").write.option("sep", "\t").option("header", True).csv(path)


def tmap_paths(path: str | list[str], n: int) -> list[str]:
    """A path for each of ``n`` annotations: one path gets the suffix _0, _1, ...; a list must have as many."""
    if isinstance(path, str):
        return [path] if n == 1 else [f"{path}_{k}" for k in range(n)]
    if len(path) != n:
        raise ValueError(f"{len(path)} paths for {n} annotations")
    return path
