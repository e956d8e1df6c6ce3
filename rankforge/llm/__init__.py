"""Training-data operators: deduplication, quality, mixing, sharding, scoring, search and packing."""
