"""Operators of a training-data pipeline: scoring, filtering, deduplication, extraction and mixing of documents."""
