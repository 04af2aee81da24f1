"""Samples by place and by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitrace.operators import spatial


def places(most: int, n: Column) -> Column:
    """Evenly spaced places 0 to n - 1, ``most`` of them."""
    return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / float(max(1, most - 1))))


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Rows of each group at ``most`` evenly spaced places (all rows of a group that has no more).

    The place is compared by arithmetic: row k is taken if a place falls on it.
    """
    w = Window.partitionBy(*keys)
    k = rows.withColumns({"_k": (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint"), "_n": F.count("*").over(w)})
    # the least i whose place reaches k has place k, or k is not taken
    step = (F.col("_n") - 1) / float(max(1, most - 1))
    i = F.ceil(F.col("_k") / F.greatest(step, F.lit(1e-12)))
    hit = lambda j: (j >= 0) & (j < most) & (F.floor(j * (F.col("_n") - 1) / float(max(1, most - 1))) == F.col("_k"))
    return k.filter((F.col("_n") <= most) | hit(i - 1) | hit(i) | hit(i + 1)).drop("_k", "_n")


def preview(points: DataFrame, size: float, most: int) -> DataFrame:
    """One point a voxel (the least id), then at most ``most`` of a scan, those of least hash: what a preview shows."""
    thin = points.groupBy("scan_id", *(spatial.cell(c, size).alias(f"v{c}") for c in "xyz")).agg(F.min("point_id").alias("point_id"))
    k = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.md5(F.col("point_id").cast("string")), "point_id"))
    return thin.select("scan_id", "point_id", k.alias("_k")).filter(F.col("_k") <= most).drop("_k")
