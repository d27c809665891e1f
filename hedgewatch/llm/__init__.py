"""Operators of a training-data pipeline: linking, sharding, tokens, duplicates, secrets, quality, packing, vectors."""
