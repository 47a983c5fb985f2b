"""Training-data operators: formatting, tokenizing, media, near-duplicate joins, quality, sharding, packing.

Nothing outside this subpackage imports it; the query registry adds it only when it can be imported.
"""
