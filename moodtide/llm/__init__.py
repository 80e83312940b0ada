"""Operators of a training-data pipeline: deduplication, tokenising, privacy, mixing, language, scoring, search."""
