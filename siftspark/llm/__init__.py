"""Training-data operators: formatting, deduplication, search, filtering and mixing.

Nothing else in the library imports this subpackage.
"""
