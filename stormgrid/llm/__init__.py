"""Operators for preparing training text: the ten numbered operators and the corpus pipeline's stages.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; `queries.py` binds them to the driver's tables.
"""
