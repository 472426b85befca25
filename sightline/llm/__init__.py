"""Operators of a training-data pipeline: search, deduplication, quality,
extraction, formatting, tokenizing and packing of documents.

Nothing else in the package imports this subpackage. ``queries.py`` binds
the operators to the driver tables.
"""
