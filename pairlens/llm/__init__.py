"""Operators for preparing training data: deduplication, filters, sampling, search, packing."""
