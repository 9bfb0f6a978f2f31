"""Training-data operators: search, near-duplicates, extraction, filters, archives, mixing, packing."""
