"""Operators for preparing training data: tokens, mixtures, shards, duplicates, search.

Nothing outside this package imports it.
"""
