"""Training-data operators for large text corpora.

Each module holds one operator with its own general interface, and the thin
query that applies it to the ``documents`` table.  Nothing else in the library
imports this subpackage.
"""
