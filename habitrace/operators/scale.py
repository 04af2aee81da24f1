"""Metric scale, gates and dimensions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGREE = 0.25


def gate_reason(status: Column, views: Column, plausible: Column, ready: Column) -> Column:
    """The first broken link of the confidence chain; NULL when all hold. The order is the contract."""
    return F.when(status != "stable", "instance_not_stable").when(views < 2, "too_few_views").when(~plausible, "implausible").when(~ready, "not_measurement_ready")


def consensus_scale(scales: DataFrame, key: str, value: str, ident: str, tolerance: float = AGREE) -> DataFrame:
    """(key, n, used, scale): the median of the largest group within ``tolerance`` of one centre.

    The first centre (least id) wins ties; fewer than two agreeing scales give NULL.
    """
    s = scales.select(key, F.col(value).alias("v"), F.col(ident).alias("i")).filter("v is not null")
    # |o - c| <= t c is a frame of fixed width around ln c: counts need a sort per key, not all pairs
    low, high = -math.log(1 - tolerance) + 1e-12, math.log(1 + tolerance) + 1e-12
    frame = f"count(*) over (partition by {key} order by lv range between {low:.17g}D preceding and {high:.17g}D following)"
    used = s.withColumn("lv", F.when(F.col("v") > 0, F.ln("v"))).withColumn("used", F.when(F.col("v") > 0, F.expr(frame)).otherwise(F.lit(0)))
    per = used.filter("used > 0").groupBy(key, "i").agg(F.sum("used").alias("used"))
    best = per.groupBy(key).agg(F.max_by("i", F.struct("used", (-F.col("i")).alias("first"))).alias("i"), F.count("*").alias("n"))
    centre = best.join(s.withColumnRenamed("v", "c"), [key, "i"]).select(key, "n", "c")
    near = s.join(centre, key).filter(F.abs(F.col("v") - F.col("c")) <= tolerance * F.col("c"))
    return near.groupBy(key).agg(F.first("n").alias("n"), F.count("*").alias("used"), F.median("v").alias("m")).select(key, "n", "used", F.when(F.col("used") >= 2, F.col("m")).alias("scale"))


def passability(width: Column) -> Column:
    return F.when(width.isNull(), None).when(width >= 0.45, "normal").when(width >= 0.30, "sideways").otherwise("not_passable")
