"""Operators of a training-data pipeline: sharding, packing, near duplicates, formatting, token files, redaction, quality."""
