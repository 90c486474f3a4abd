"""Training-data operators: sharding, filters, near-duplicates, mixing, packing, media."""
