"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names; the registered queries live in ``queries.py``.
"""
