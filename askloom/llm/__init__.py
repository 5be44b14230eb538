"""Operators for preparing training data: search, deduplication, scoring, extraction, mixing, tokens."""
