"""Operators for training-data pipelines over the table ``documents`` and its neighbours.

Nothing outside this package imports it; ``queries`` holds the registered queries and their SQL.
"""
