"""Operators for training-data pipelines: one module per operator.

Nothing outside this folder imports it. ``registry`` holds the queries and SQL.
"""
