"""Training-data operators: deduplication, filtering, tokenising and packing of document tables."""
