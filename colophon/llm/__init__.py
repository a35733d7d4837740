"""Training-data operators: filtering, deduplication, mixing, packing and search.

Nothing else in the library imports this subpackage; its queries and their SQL
are in :mod:`colophon.llm.queries`.
"""
