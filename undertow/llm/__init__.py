"""Operators for preparing text corpora: scoring, near-duplicates, decontamination, token ids, filters.

Each module holds one operator. Nothing else in the library imports this package.
"""
