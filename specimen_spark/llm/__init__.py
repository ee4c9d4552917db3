"""Operators for training-data pipelines: text quality, language, deduplication, packing, scoring, archives, search."""
