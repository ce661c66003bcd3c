"""Training-data operators: extraction, deduplication, tokens, packing, scoring, archives, search, quality."""
