"""Training-data operators: deduplication, search, packing, scoring and scanning of document tables.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries and their SQL.
"""
