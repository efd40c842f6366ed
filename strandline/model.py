"""Canonical schemas.  Container order matters for numbering and writing, so it is kept in ordinal columns."""

BLOCKS = "array<struct<start:bigint,end:bigint>>"
TRANSCRIPTS = f"seq string, seq_ord bigint, gene_ord bigint, tx_ord int, gene_name string, tx_name string, strand string, cds {BLOCKS}"
SEQUENCES = "name string, seq_ord bigint, sequence string"
CDS, INTRON, INTERGENIC = "cds", "intron", "intergenic"
#: What makes two transcripts equal; names do not.
STRUCTURE = ("seq", "strand", "cds")
