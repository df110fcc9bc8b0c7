"""Training-data operators: dedup, filtering, tokenising, packing and archiving."""
