"""Training-data operators: deduplication, packing, search, formatting, classifiers.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.SQL`` hold the registered queries.
"""
