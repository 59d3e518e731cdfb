"""Operators of a training-data pipeline: deduplication, filtering, mixing and sharding of text."""
