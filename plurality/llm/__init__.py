"""Operators for preparing training data: deduplication, filters, mixing, search, sharding and packing."""
