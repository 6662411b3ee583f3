"""Operators for training-data pipelines: search, deduplication, scoring, classification, mixing and formatting."""
