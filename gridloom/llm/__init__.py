"""Operators of a training-data pipeline: packing, search, tokenising, deduplication, scoring, filtering."""
