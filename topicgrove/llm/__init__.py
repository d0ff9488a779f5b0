"""Operators for building training corpora: scans, near-duplicates, sharding and token files.

Nothing outside this package imports it; ``queries`` holds what the entry module registers.
"""
