"""Operators for text corpora: sharding, deduplication, filtering, classification and mixing."""
