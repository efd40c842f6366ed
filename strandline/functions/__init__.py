"""Column functions on nucleotide strings."""
