"""Training-data operators: packing, deduplication, quality, scans, mixing, language models.

Nothing outside this subpackage imports it; ``queries`` holds its registered queries.
"""
