"""Training-data operators: deduplication, filtering, packing, sanitising, scoring.

Nothing outside this subpackage imports it.
"""
