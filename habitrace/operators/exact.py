"""Sums, averages and quantiles that are the same to the last bit however rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def added(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``rows`` with the running sum of a group in the order of ``order``, for ``in_order`` and ``mean_in_order``.

    Sums of doubles hang on their order in the last bit, and limits, ranks and
    roundings can hang on that bit. Here it is one row after the other, as a
    reader in the table's order adds them, however Spark deals out the rows.
    """
    w = Window.partitionBy(*keys).orderBy(order, value)
    return rows.withColumns({"_place": F.row_number().over(w), "_sum": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})


def in_order() -> Column:
    """The sum of a group of ``added``, as an aggregate."""
    return F.max_by("_sum", "_place")


def mean_in_order(value: str) -> Column:
    """``in_order`` by the number of values."""
    return F.try_divide(in_order(), F.count(value))


def _fma(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, total, a column for each name in ``at``): interpolated quantiles of a double column; null without values.

    Between two values it is ``low * (1 - t) + high * t`` with the first
    product and the sum rounded once, as the SQL engine has it (``percentile``
    rounds both products). Equal values of a group are counted before they meet.
    """
    v, w = F.col(value), Window.partitionBy(*keys)
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = counted.select(*keys, value, "_c", F.sum("_c").over(w.orderBy(v.asc_nulls_last())).alias("_to"), F.coalesce(F.sum(F.when(v.isNotNull(), F.col("_c"))).over(w), F.lit(0)).alias("_n"))
    place = {name: (F.col("_n") - 1) * F.lit(p) for name, p in at.items()}
    held = lambda k: F.max(F.when(v.isNotNull() & (F.col("_to") > k) & (F.col("_to") - F.col("_c") <= k), v))
    ends = placed.groupBy(*keys).agg(F.sum("_c").alias("total"), F.first("_n").alias("_n"), *(held(f(k)).alias(f"_{f.__name__}_{name}") for name, k in place.items() for f in (F.floor, F.ceil)))

    def between(name: str) -> Column:
        low, high, t = F.col(f"_floor_{name}"), F.col(f"_ceil_{name}"), place[name] - F.floor(place[name])
        return F.when(t > 0, F.when(low.isNotNull(), _fma(low, 1 - t, high * t))).otherwise(low)

    return ends.select(*keys, "total", *(between(name).alias(name) for name in at))
