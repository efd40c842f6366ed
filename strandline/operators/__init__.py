"""Relational operators on transcripts, intervals, labels and sequences."""
