"""Training-data operators: scoring, deduplication, tokens, packing, sharding.

Nothing outside this subpackage imports it.
"""
