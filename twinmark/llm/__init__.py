"""Training-data operators: search, tokens, sharding, filters, chat rendering, packing, scoring, secrets, near-dedup.

Nothing else in the library imports this subpackage.
"""
