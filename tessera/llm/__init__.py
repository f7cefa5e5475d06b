"""Training-data operators: sharding, deduplication, archives, extraction, tokens, mixing, quality, search.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query per operator.
"""
