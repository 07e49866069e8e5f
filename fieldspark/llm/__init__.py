"""Operators for large text corpora: search, packing, scoring, deduplication, scans and token files."""
