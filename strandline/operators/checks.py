"""Quality checks of transcripts against their sequences.  Each returns what fails; ``without`` removes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codons import stop_codons
from ..functions.nucleotides import complement, is_repeat_masked, kmers
from .sequences import CHUNK, chunk_table, lengths, put_together, with_letters
from .transcripts import coding_length, end, exploded, introns, non_empty

# The usual signals at block borders.
STARTS, STOPS, INTRON_BEGINS, INTRON_ENDS = ("ATG",), ("TAG", "TAA", "TGA"), ("GT", "GC"), ("AG",)


KEY = ["seq", "strand", "tx"]


def coding_sequences(transcripts: DataFrame, sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds ``coding``, the spliced and oriented blocks.

    Blocks look their letters up in chunks of the sequences.  What lies beyond a sequence has no letters; transcripts without
    blocks, or of unknown sequences, are left out.  (seq, strand, tx) names a transcript.
    """
    rows = non_empty(transcripts).join(lengths(sequences).select("seq"), "seq")
    pieces = with_letters(exploded(rows.select(*KEY, "cds")), chunk_table(sequences, size), "cds_start", "cds_end", size)
    joined = pieces.groupBy(*KEY).agg(put_together(F.collect_list(F.struct("from", "letters"))).alias("_coding"))
    oriented = F.when(F.col("strand") == "-", complement(F.col("_coding"), reverse=True)).otherwise(F.col("_coding"))
    return rows.join(joined, KEY).select(*rows.columns, oriented.alias("coding"))


def short_coding(transcripts: DataFrame, length: int) -> DataFrame:
    return transcripts.where(coding_length(F.col("cds")) < length)


def inframe_stops(transcripts: DataFrame, sequences: DataFrame, codons: tuple[str, ...] | None = None, table: int | None = None) -> DataFrame:
    """Transcripts of two codons at least with a stop codon before the last whole codon; case does not count."""
    stops = codons or (tuple(c for c, _ in stop_codons(table)) if table else STOPS)
    rows = coding_sequences(transcripts.where(coding_length(F.col("cds")) >= 6), sequences)
    triplets = kmers(F.col("coding"), 3)
    rows = rows.withColumn("_c", triplets).where(F.arrays_overlap(F.slice("_c", 1, F.greatest(F.size("_c") - 1, F.lit(0))), F.array(*map(F.lit, stops))))
    return rows.drop("_c", "coding")


def boundary_faults(
    transcripts: DataFrame,
    sequences: DataFrame,
    starts: tuple[str, ...] = STARTS,
    stops: tuple[str, ...] = STOPS,
    intron_begins: tuple[str, ...] = INTRON_BEGINS,
    intron_ends: tuple[str, ...] = INTRON_ENDS,
) -> DataFrame:
    """Adds fault (start, stop, intron) and, for introns, bad_intron_begins and bad_intron_ends; one row a transcript.

    A wrong start hides the rest, a wrong stop hides introns.  On the minus strand introns begin at their right end.
    """
    rows = non_empty(transcripts).join(lengths(sequences).select("seq"), "seq")
    kind = lambda name, low, high: F.struct(F.lit(name).alias("kind"), low.alias("start"), high.alias("end"))
    wanted = F.concat(
        F.transform("cds", lambda c: kind("block", c["start"], c["end"])),
        F.flatten(F.transform(introns(F.col("cds")), lambda i: F.array(kind("left", i["start"], i["start"] + 2), kind("right", i["end"] - 2, i["end"])))),
    )
    pieces = with_letters(rows.select(*KEY, F.inline(wanted)), chunk_table(sequences)).withColumn("letters", F.upper("letters"))
    minus = F.col("strand") == "-"
    signal = F.when(minus, F.reverse(F.translate("letters", "ACGT", "TGCA"))).otherwise(F.col("letters"))
    begins = F.col("kind") == F.when(minus, "right").otherwise("left")
    ends = F.col("kind") == F.when(minus, "left").otherwise("right")
    judged = pieces.groupBy(*KEY).agg(
        put_together(F.collect_list(F.when(F.col("kind") == "block", F.struct("from", "letters")))).alias("_coding"),
        F.count_if(begins & ~signal.isin(*intron_begins)).alias("_b"),
        F.count_if(ends & ~signal.isin(*intron_ends)).alias("_e"),
    )
    coding = F.when(minus, complement(F.col("_coding"), reverse=True)).otherwise(F.col("_coding"))
    fault = F.when(~F.substring(coding, F.lit(1), F.lit(3)).isin(*starts), "start").when(~F.right(coding, F.lit(3)).isin(*stops), "stop")
    fault = F.coalesce(fault, F.when((F.col("_b") > 0) | (F.col("_e") > 0), F.lit("intron")))
    faults = judged.select(*KEY, fault.alias("fault"), "_b", "_e").where("fault IS NOT NULL")
    shown = [F.when(F.col("fault") == "intron", F.col(c)).otherwise(F.lit(0).cast("long")).alias(n) for c, n in (("_b", "bad_intron_begins"), ("_e", "bad_intron_ends"))]
    return rows.join(faults, KEY).select(*rows.columns, "fault", *shown)


def coding_repeats(transcripts: DataFrame, sequences: DataFrame) -> DataFrame:
    """Transcripts whose coding bases include repeat-masked ones."""
    return coding_sequences(transcripts, sequences).where(is_repeat_masked(F.col("coding"))).drop("coding")


def out_of_bounds(transcripts: DataFrame, sequences: DataFrame) -> DataFrame:
    """Transcripts that end beyond their sequence."""
    rows = non_empty(transcripts).join(lengths(sequences), "seq")
    return rows.where(end(F.col("cds")) > F.col("length")).select(*transcripts.columns)
