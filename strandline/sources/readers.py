"""Readers.  Every one is a plan over Spark's text source, so it reads any store and any number of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nucleotides import name_of
from ..operators.histograms import histogram


def read_fasta(spark: SparkSession, path: str | list[str], include: list[str] | None = None, exclude: list[str] | None = None, split_name: bool = True) -> DataFrame:
    """(name, seq_ord, sequence, file): one row a record; gzip is read as it is.  Names are cut at the first blank.

    Carriage returns and white space in the body go; records without body are empty sequences.  seq_ord follows the files.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq_ord"))
    clean = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    rows = records.where(F.trim("value") != "").withColumn("_r", clean)
    header = F.substring_index("_r", "\n", 1)
    body = F.when(F.instr("_r", "\n") > 0, F.regexp_replace(F.expr("substr(_r, instr(_r, '\n') + 1)"), r"\s+", "")).otherwise("")
    rows = rows.select((name_of(header) if split_name else header).alias("name"), "seq_ord", body.alias("sequence"), "file")
    if include is not None:
        rows = rows.where(F.col("name").isin(include))
    return rows.where(~F.col("name").isin(exclude)) if exclude is not None else rows


def fasta_from_string(spark: SparkSession, text: str, name: str = "seq1") -> DataFrame:
    """One sequence; line ends in the string are dropped."""
    return spark.createDataFrame([(name, 0, "".join(text.split()))], "name string, seq_ord long, sequence string")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are neither blank nor comments, with their order."""
    rows = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("line"))
    return rows.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))


def parse_genepred(lines: DataFrame, use_cds_bounds: bool = False) -> DataFrame:
    """Transcripts of GenePred rows ``(value, line)``, each a gene of its own.

    Exons are the blocks, as the format's first tables have no others; ``use_cds_bounds`` cuts them to the coding range.
    Further columns do not count.
    """
    f = F.split("value", "\t")
    ends = [F.transform(F.split(F.regexp_replace(F.get(f, F.lit(k)), ",$", ""), ","), lambda x: x.cast("long")) for k in (8, 9)]
    blocks = F.array_sort(F.zip_with(*ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
    if use_cds_bounds:
        low, high = F.get(f, F.lit(5)).cast("long"), F.get(f, F.lit(6)).cast("long")
        cut = F.transform(blocks, lambda c: F.struct(F.greatest(c["start"], low).alias("start"), F.least(c["end"], high).alias("end")))
        blocks = F.filter(cut, lambda c: c["start"] < c["end"])
    empty = F.coalesce(F.get(f, F.lit(8)), F.lit("")) == ""
    blocks = F.when(empty, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(blocks)
    return lines.select(
        F.get(f, F.lit(1)).alias("seq"), F.col("line").alias("gene_ord"), F.col("line").alias("tx"), F.col("line").alias("gene"), F.get(f, F.lit(0)).alias("tx_name"), F.get(f, F.lit(2)).alias("strand"), blocks.alias("cds")
    )


def read_genepred(spark: SparkSession, path: str | list[str], use_cds_bounds: bool = False) -> DataFrame:
    return parse_genepred(_lines(spark, path), use_cds_bounds)


def _nine_columns(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    names = ("seq", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
    rows = lines.select("line", *(F.get(f, F.lit(k)).alias(n) for k, n in enumerate(names)))
    return rows.withColumns({"start": F.col("start").cast("long") - 1, "end": F.col("end").cast("long")})


def _from_features(rows: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Transcripts from feature rows with tx_name and gene_name; of ``parts`` the first kind that a transcript has gives its blocks.

    Rows of other features may tell a transcript's gene; transcripts without parts are left out.
    """
    blocks = rows.where(F.col("tx_name").isNotNull())
    per_part = [F.array_sort(F.collect_set(F.when(F.col("feature") == p, F.struct("start", "end")))).alias(f"_{k}") for k, p in enumerate(parts)]
    grouped = blocks.groupBy("seq", "strand", "tx_name").agg(F.min(F.when(F.col("feature").isin(*parts), F.col("line"))).alias("tx"), F.first("gene_name", ignorenulls=True).alias("gene_name"), *per_part)
    chosen = F.coalesce(*(F.when(F.size(f"_{k}") > 0, F.col(f"_{k}")) for k in range(len(parts))))
    grouped = grouped.where("tx IS NOT NULL").withColumn("cds", chosen).drop(*(f"_{k}" for k in range(len(parts))))
    genes = grouped.groupBy("seq", "strand", "gene_name").agg(F.min("tx").alias("gene"))
    known = grouped.join(genes, ["seq", "strand", "gene_name"], "left")
    return known.select("seq", F.coalesce("gene", "tx").alias("gene_ord"), "tx", F.coalesce("gene", "tx").alias("gene"), "gene_name", "tx_name", "strand", "cds")


def parse_gtf(lines: DataFrame) -> DataFrame:
    def attribute(name: str):
        found = F.regexp_extract("attributes", f'{name} "([^"]*)"', 1)
        return F.when(found != "", found)

    rows = _nine_columns(lines).withColumns({"tx_name": attribute("transcript_id"), "gene_name": attribute("gene_id")})
    return _from_features(rows.where("feature IN ('CDS', 'exon')"), ("CDS", "exon"))


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Transcripts by transcript_id and genes by gene_id; coding blocks, or exons of transcripts without any."""
    return parse_gtf(_lines(spark, path))


def parse_gff3(lines: DataFrame) -> DataFrame:
    def attribute(name: str):
        found = F.regexp_extract("attributes", f"(?:^|;){name}=([^;]*)", 1)
        return F.when(found != "", found)

    rows = _nine_columns(lines).withColumns({"id": attribute("ID"), "parent": attribute("Parent")})
    # Parts name their transcripts, transcripts their gene; one grouping brings both together.
    owner = F.col("feature").isin("mRNA", "transcript")
    named = rows.where(owner | F.col("feature").isin("CDS", "exon")).select(
        "*", F.when(owner, F.col("parent")).alias("gene_name"), F.explode(F.when(owner, F.array("id")).otherwise(F.split("parent", ","))).alias("tx_name")
    )
    return _from_features(named, ("CDS", "exon"))


def read_gff3(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_gff3(_lines(spark, path))


# Friendly names of tmap columns.
TMAP_NAMES = {"Length": "len", "Exons": "num_exons", "FPKM": "FPKM", "TPM": "TPM", "Coverage": "cov", "Reference length": "ref_match_len"}


def tmap_column(name: str, columns: list[str]) -> str:
    """The column that a friendly name or a column's own name means; an unknown one is refused."""
    found = TMAP_NAMES.get(name, name)
    if found not in columns:
        raise ValueError(f"no column {name}: one of {', '.join([*TMAP_NAMES, *columns])} is needed")
    return found


def read_tmap(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated class codes with a header; columns of numbers are left as text until they are used."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def tmap_histograms(tmap: DataFrame, names: list[str], bins: int) -> DataFrame:
    """Histograms for each class code over columns named as ``tmap_column`` allows; ``column`` has the names as they were given."""
    parts = [histogram(tmap, tmap_column(n, tmap.columns), bins).withColumn("column", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, parts)


def parse_stats(lines: DataFrame) -> DataFrame:
    """(level, sensitivity, precision, missed, novel) from lines ``(value)`` of a comparison report.

    Levels are lower-case with underscores and singular; a precision of nan is 0, a sensitivity of nan stays; missed and novel
    are shares rounded to three places.
    """
    level = F.regexp_replace(F.lower(F.trim(F.regexp_extract("value", r"^\s*([A-Za-z ]+?) level:", 1))), " ", "_")
    pair = r"level:\s+(-?[0-9.]+|-?nan)\s*\|\s*(-?[0-9.]+|-?nan)"

    def number(k: int, nan: float):
        text = F.regexp_extract("value", pair, k)
        return F.when(text.contains("nan"), F.lit(nan)).when(text != "", text.cast("double"))

    main = lines.where(F.col("value").rlike(pair)).select(level.alias("level"), number(1, float("nan")).alias("sensitivity"), number(2, 0.0).alias("precision"))
    extra = r"^\s*(Missed|Novel) ([a-z]+):\s+\d+/\d+\s+\(\s*([0-9.]+)%\)"
    plural = F.regexp_extract("value", extra, 2)
    one = F.when(plural == "loci", "locus").otherwise(F.regexp_replace(plural, "s$", ""))
    shares = lines.where(F.col("value").rlike(extra)).select(one.alias("level"), F.lower(F.regexp_extract("value", extra, 1)).alias("what"), F.round(F.regexp_extract("value", extra, 3).cast("double") / 100, 3).alias("share"))
    return main.join(shares.groupBy("level").pivot("what", ["missed", "novel"]).agg(F.first("share")), "level", "left")


def read_stats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_stats(spark.read.text(path))
