"""Operators of a training-data pipeline: deduplication, tokens, archives, sharding, quality, packing, chat."""
