"""Operators of a training-data pipeline: cleaning, de-duplication, search, mixing, sharding.

Nothing outside this package imports it; its queries are in ``tickwise.llm.queries``.
"""
