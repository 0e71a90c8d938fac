"""Training-data operators: deduplication, filtering, scoring and mixing of large text tables.

Nothing outside this subpackage imports it.
"""
