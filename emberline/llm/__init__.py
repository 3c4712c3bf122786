"""Operators that prepare training text: mixing, deduplication, search, record files, privacy, models."""
