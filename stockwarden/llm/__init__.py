"""Operators for preparing training data: deduplication, classifiers, mixing, archives, packing, extraction and search."""
