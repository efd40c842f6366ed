"""Training-data operators: counting, encoding, deduplication, filtering and scanning of text corpora."""
