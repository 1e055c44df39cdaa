"""Training-data operators: search, packing, deduplication, quality, language, PII, tokens."""
