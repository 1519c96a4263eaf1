"""Operators of a training-data pipeline: one module per operator, queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
