"""Readers and writers of annotation and sequence files."""
