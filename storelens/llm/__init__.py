"""Operators for training-data pipelines: mixing, scoring, packing, filtering and deduplication."""
