"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; `queries.py` lists the registered queries.
"""
