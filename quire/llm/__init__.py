"""Training-data operators: deduplication, tokens, search, packing, quality and language models."""
