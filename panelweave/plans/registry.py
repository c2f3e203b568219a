"""The registered queries and, where SQL can express them, their checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must return the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def r6(column: Column | str, digits: int = 6) -> Column:
    """Round half away from zero for comparison, by scaling, as the check engine does.

    Spark's own ``round`` works on the shortest decimal form, which differs on ties. Adding zero turns
    a negative zero into a plain one.
    """
    c = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round the named columns in place."""
    return df.withColumns({c: r6(c, digits) for c in columns})


@lru_cache(maxsize=1)
def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import all modules that register queries."""
    from panelweave.plans import entries_ingest, entries_linkage, entries_models, entries_tables  # noqa: F401

    return QUERIES, CHECKS
