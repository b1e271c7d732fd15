"""Operators of a training-data pipeline: ten operators over documents, pages and conversations.

Nothing outside this package imports it. `queries.py` holds the thin queries with production
parameters, each operator lives in a module of its own.
"""
