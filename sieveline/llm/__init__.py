"""Operators for preparing training text at scale.

Nothing outside this folder imports it. Every operator is a function from
DataFrames to DataFrames; ``queries.py`` holds the registered queries.
"""
