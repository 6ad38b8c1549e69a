"""Training-data operators: search, deduplication, mixing, archives, tokens.

Nothing outside this package imports it; delete it and the rest still works.
"""
