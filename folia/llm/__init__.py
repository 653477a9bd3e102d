"""Operators for training-data pipelines: sharding, filtering, deduplication, mixing and packing.

Nothing outside this subpackage imports it.
"""
