"""Operators of a training-data pipeline: filtering, near-duplicates, mixing, packing, formatting.

Nothing outside this package imports it; of the rest of the library it imports tidemark.tables.
"""
