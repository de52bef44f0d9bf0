"""Relational operators: joins, deduplication, splits, sampling, statistics."""
