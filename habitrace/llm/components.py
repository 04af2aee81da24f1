"""Distributed connected components by alternating large-star and small-star.

Each round is two aggregations and two joins on the edge list; no vertex ever
gathers its neighbours in one task, and nothing is collected but two numbers
that tell whether the edge list still changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.llm.store import settled


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is hooked to the least vertex in reach."""
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are hooked to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    hooked = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return hooked.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("hi", "lo")
    row = edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every vertex that has an edge.

    ``component`` is the least vertex reachable. Self loops, repeated edges and
    edges with a null end are ignored; without edges the result is empty.
    """
    a, b = F.col(left), F.col(right)
    work = settled(edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = _state(work)
    while before[0]:
        work = settled(_small_star(_large_star(work)))
        now = _state(work)
        if now == before:
            break
        before = now
    return work.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        work.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
