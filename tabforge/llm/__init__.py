"""Operators for training-data pipelines (mixing, sharding, deduplication, tokens, ...).

Nothing else in the library imports this subpackage; ``queries.py`` holds the
thin registered queries and their DuckDB statements.
"""
