"""Operators for large text corpora: sharding, near-duplicates, packing, classifiers, search."""
