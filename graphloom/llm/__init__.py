"""Training-data operators: scoring, fingerprints, near-duplicates, filters, mixing, packing, search."""
