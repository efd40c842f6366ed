"""Conversion between annotation formats; transcripts are the hub, so every pair of formats is possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.transcripts import named, non_empty, numbered
from ..sources.appends import Commit, append_text, exists, last_commit
from ..sources.readers import read_genepred, read_gff3, read_gtf
from ..sources.writers import genepred_lines, gff3_lines, gtf_lines
from ..tables import Workspace

READERS = {"gp": read_genepred, "gtf": read_gtf, "gff": read_gff3, "gff3": read_gff3}
WRITERS = {"gp": genepred_lines, "gtf": gtf_lines, "gff": gff3_lines, "gff3": gff3_lines}


def format_of(path: str) -> str:
    kind = path.removesuffix(".gz").rpartition(".")[2]
    if kind not in READERS:
        raise ValueError(f"unknown annotation format: {path}")
    return kind


def load_annotation(spark: SparkSession, path: str) -> DataFrame:
    return READERS[format_of(path)](spark, path)


def annotation_lines(transcripts: DataFrame, kind: str, first_gene_id: int = 1, header: bool = True) -> DataFrame:
    """Numbered, named rows of a format, with the columns that order them; ``header`` is GFF3's."""
    if kind not in WRITERS:
        raise ValueError(f"unknown annotation format: {kind}")
    rows = named(numbered(transcripts, first_gene_id))
    return gff3_lines(rows, header=header) if WRITERS[kind] is gff3_lines else WRITERS[kind](rows)


def write_annotation(transcripts: DataFrame, target: str, append: bool = False, first_gene_id: int | None = None) -> Commit:
    """Writes transcripts in the format that the suffix of ``target`` names (``.gz`` after it compresses), and commits them.

    Gene ids count from ``first_gene_id``, or go on from the target's last write.  A header is written once.  An existing target
    is refused unless rows are appended; one without commits, from elsewhere, has its header already.
    """
    spark, kind = transcripts.sparkSession, format_of(target)
    there = exists(spark, target)
    if there and not append:
        raise ValueError(f"{target} exists already")
    last = last_commit(spark, target) if there else None
    first = first_gene_id if first_gene_id is not None else last.next_gene_id if last else 1
    header = not there or (last is not None and not last.header)
    begin = Workspace.mark()
    space = Workspace(spark, "annotation")
    rows = space.keep(transcripts)
    order = ("gene_id", "transcript_id") if kind == "gp" else ("gene_id", "transcript_id", "rank")
    n_genes = non_empty(rows).select("seq", "strand", "gene").distinct().count()
    made = append_text(annotation_lines(rows, kind, first, header), target, order=order, gzip=target.endswith(".gz"), next_gene_id=first + n_genes, header=True)
    Workspace.drop_since(begin)
    return made


def convert(source: DataFrame | str, target: str, spark: SparkSession | None = None, append: bool = False, first_gene_id: int | None = None) -> Commit:
    """Writes transcripts, or an annotation file, as ``write_annotation`` does."""
    if isinstance(source, str):
        source = load_annotation(spark or SparkSession.active(), source)
    return write_annotation(source, target, append, first_gene_id)
