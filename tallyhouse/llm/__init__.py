"""Training-data operators: deduplication, quality, language, archives, tokens, packing."""
