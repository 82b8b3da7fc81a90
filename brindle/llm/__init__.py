"""Operators for preparing training data, each a job over whole tables.

Nothing outside this package imports it. ``queries.py`` registers one query for each operator.
"""
