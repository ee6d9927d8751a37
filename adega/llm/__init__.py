"""Operators of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator with a general interface; ``catalog`` applies them
to the driver's tables.  Nothing else in the library imports this subpackage.
"""
