"""Training-data operators: deduplication, scoring, mixing, search, filters, formatting and tokens.

Nothing else in the library imports this subpackage.
"""
