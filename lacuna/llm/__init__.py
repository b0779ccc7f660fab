"""Training-data operators: mixing, packing, deduplication, quality, archives,
language identification and exact search.

Nothing else in the library imports this subpackage.  ``QUERIES`` and
``ORACLE_SQL`` in :mod:`lacuna.llm.catalog` are what the entry module registers.
"""
