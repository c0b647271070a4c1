"""Training-data operators: filtering, classification, near-duplicates, mixing, sharding, packing, search and captures."""
