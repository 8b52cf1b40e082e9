"""Operators for large text corpora: filters, deduplication, tokenisation and packing."""
