"""Column expressions on nucleotide strings.

Sequences are kept as letters ``ACGTN`` and, where repeats are masked, ``acgt``; every other character counts as N.  ``-`` pads
chunks.  Positions are zero-based and ranges half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codons import codon_column

LETTERS = "ACGTNacgt"


def normalised(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ACGTacgt]", "N")


def encoded(seq: Column) -> Column:
    """One digit a nucleotide: A C G T N a c g t as 0 to 8."""
    return F.translate(normalised(seq), LETTERS, "012345678")


def decoded(codes: Column, repeats: bool = True) -> Column:
    letters = F.translate(codes, "012345678", LETTERS)
    return letters if repeats else F.upper(letters)


def complement(seq: Column, reverse: bool = False) -> Column:
    """Case is kept; N stays, and padding becomes N."""
    out = F.translate(seq, "ACGTacgt-", "TGCAtgcaN")
    return F.reverse(out) if reverse else out


def is_repeat_masked(seq: Column) -> Column:
    return seq.rlike("[acgt]")


def name_of(header: Column) -> Column:
    """A record's name ends at the first blank."""
    return F.substring_index(header, " ", 1)


def slice_of(seq: Column, start: Column, end: Column, seq_start: Column | None = None) -> Column:
    """Part of a sequence by absolute positions; a range outside of it fails the query."""
    base = F.lit(0) if seq_start is None else seq_start
    inside = (start >= base) & (end >= start) & (end <= base + F.length(seq))
    return F.when(inside, F.substring(seq, (start - base + 1).cast("int"), (end - start).cast("int"))).otherwise(F.raise_error(F.lit("range outside of the sequence")).cast("string"))


def places(count: Column) -> Column:
    """0 to count - 1, and no element for 0 (``sequence`` would count down)."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kmers(seq: Column, k: int = 3) -> Column:
    """Non-overlapping k-mers in upper case; the remainder is left out."""
    return F.regexp_extract_all(F.upper(normalised(seq)), F.lit(f".{{{k}}}"), F.lit(0))


def overlapping_kmers(seq: Column, k: int = 3) -> Column:
    return bound(F.upper(normalised(seq)), lambda upper: F.transform(places(F.length(upper) - k + 1), lambda i: F.substring(upper, i + 1, F.lit(k))))


def kmer_code(kmer: Column) -> Column:
    """Three bits a base, the first base highest: an octal number."""
    return F.conv(F.translate(kmer, "ACGTN", "01234"), 8, 10).cast("int")


def kmer_codes(seq: Column, k: int = 3) -> Column:
    if k > 5:
        raise ValueError("codes of more than five bases do not fit sixteen bits")
    return F.transform(kmers(seq, k), kmer_code)


def chunk_array(seq: Column, size: int, drop_remainder: bool = False) -> Column:
    """Chunks of ``size`` letters, the last padded with ``-`` or, if asked, left out.  One pass over the sequence."""
    parts = F.regexp_extract_all(seq, F.lit(f"(?s).{{{size}}}" if drop_remainder else f"(?s).{{1,{size}}}"), F.lit(0))
    return parts if drop_remainder else F.transform(parts, lambda x: F.rpad(x, size, "-"))


def splice(seq: Column, cds: Column, strand: Column) -> Column:
    """Blocks of ``cds`` (structs of start and end) put together, reverse complemented on the minus strand.

    Blocks beyond the sequence are cut at its end; no block gives null.
    """
    joined = F.array_join(F.transform(cds, lambda c: F.substring(seq, (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int"))), "")
    return F.when(F.size(cds) > 0, F.when(strand == "-", complement(joined, reverse=True)).otherwise(joined))


def protein(coding: Column, table: int = 1, drop_terminal_stop: bool = True, require_multiple_of_three: bool = False) -> Column:
    """Amino acids of a coding sequence; a codon with an unknown base is X, incomplete codons are left out or refused."""
    code = codon_column(table)
    acids = F.array_join(F.transform(kmers(coding, 3), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")
    out = F.regexp_replace(acids, r"\*$", "") if drop_terminal_stop else acids
    if require_multiple_of_three:
        out = F.when(F.length(coding) % 3 == 0, out).otherwise(F.raise_error(F.lit("coding length is not a multiple of three")).cast("string"))
    return out


def one_hot(seq: Column, repeats: str = "track", unknown: str = "track", pad: str = "N") -> Column:
    """Per nucleotide an array of floats.

    repeats: ``track`` adds a column that marks masked bases, ``omit`` folds case, ``expand`` gives masked bases columns of
    their own.  unknown: ``uniform`` drops the column of N and spreads it over the four bases.  Padding is read as ``pad``.
    """
    if repeats not in ("track", "omit", "expand"):
        raise ValueError(f"repeats: {repeats}")
    width = 9 if repeats == "expand" else 5
    rows = {}
    for code, letter in enumerate(LETTERS):
        at = code if repeats == "expand" or code < 5 else code - 5
        row = [float(k == at) for k in range(width)]
        if repeats == "track":
            row.append(float(code > 4))
        if unknown == "uniform":
            if at == 4:
                row[:4] = [0.25] * 4
            del row[4]
        rows[letter] = row
    table = F.create_map(*(x for letter, row in rows.items() for x in (F.lit(letter), F.array(*map(F.lit, row)).cast("array<float>"))))
    letters = F.filter(F.split(normalised(F.translate(seq, "-", pad)), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.element_at(table, c))


def letter_count(seq: Column, letters: str) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("long")


def composition(seq: Column, separate_repeats: bool = False) -> dict[str, Column]:
    """Counts of the five bases with case folded, or of all nine letters."""
    plain = normalised(seq)
    if separate_repeats:
        return {c: letter_count(plain, c) for c in LETTERS}
    return {c: letter_count(plain, c if c == "N" else c + c.lower()) for c in "ACGTN"}


def rounded_up(length: int, factors: list[int]) -> int:
    """The least multiple of all factors that is not below ``length``."""
    import math

    step = math.lcm(*factors)
    if step == 0 or length <= 0:
        raise ValueError("length and factors must be positive")
    return -(-length // step) * step
