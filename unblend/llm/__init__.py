"""Operators that prepare large text collections for model training.

Nothing outside this package imports it. Each operator takes and returns
DataFrames; ``queries`` binds them to the tables of a data folder.
"""
