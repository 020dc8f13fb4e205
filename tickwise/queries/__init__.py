"""Every operator bound to the given tables, with the SQL its result must equal.

The bindings only choose columns and parameters; the work is in ``operators``, ``sources``,
``plans`` and ``streaming``. All queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's name."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from tickwise.plans import summary  # noqa: F401
    from tickwise.queries import (  # noqa: F401
        align_labels,
        catalog_joins,
        evaluation,
        projections,
        splits_scaling,
        streams,
        windows_pooling,
    )
