"""Operators of a training-data pipeline (language ID, deduplication, mixing, sharding, scoring and so on).

Nothing outside this package imports it; ``queries.py`` registers one query per operator.
"""
