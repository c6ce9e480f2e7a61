"""Training-data operators: quality, near-duplicates, sharding, packing, token files."""
