"""Operators for building training corpora: dedup, filters, scoring, packing, token files."""
