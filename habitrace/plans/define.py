"""Where queries are registered: a function (spark, sf_dir) with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; without SQL only its rows are checked."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def r6(value: Column | str) -> Column:
    """Six decimals, and no negative zero, so that other engines' sums compare."""
    return F.round(value, 6) + F.lit(0.0)


def d6(value: Column | str) -> Column:
    """``r6`` of a double to the last bit of ``q6``: scaled, rounded and scaled back. ``round`` goes by the decimal digits and parts from it at halves."""
    v = F.col(value) if isinstance(value, str) else value
    scaled = v * F.lit(1e6)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(1e6)).otherwise(v) + F.lit(0.0)


def q6(value: str) -> str:
    """``r6`` in SQL."""
    return f"(round({value}, 6) + 0.0)"
