"""Training-data operators: packing, deduplication, sharding, mixing, fingerprints, scoring, search."""
