"""Operators for large text corpora: fingerprints, tokens, neighbours, dedup, packing, archives."""
