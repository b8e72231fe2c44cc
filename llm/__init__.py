"""Operators for training-data preparation over document tables.

Each module holds one operator with its own general interface and the
registered query that applies it to a whole table; :mod:`llm.catalog` lists
the queries and their DuckDB equivalents.
"""
