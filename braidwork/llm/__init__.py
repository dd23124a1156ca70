"""Operators for large text collections: near-duplicates, archives, media, scoring, tokenising.

Nothing outside this subpackage imports it.
"""
