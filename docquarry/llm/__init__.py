"""Operators for large text corpora: tokens, sharding, search, deduplication, archives and scoring.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
