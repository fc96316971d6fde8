"""Corpus preparation at scale: deduplication, packing, search, language, quality, tokens."""
