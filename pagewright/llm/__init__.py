"""Training-data operators: tokenising, deduplication, filtering, packing, sharding and search.

Nothing else in the library imports this subpackage.
"""
