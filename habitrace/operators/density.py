"""Density clusters from cells: what all pairs within the radius would give, without making them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.operators import graph, spatial
from habitrace.session import settled

PLACE, SMALL, WIDE = ["scan_id", *"xyz"], ["scan_id", "sx", "sy", "sz"], ["scan_id", "gx", "gy", "gz"]


def places(points: DataFrame) -> DataFrame:
    """(scan_id, x, y, z, n, first): finite places with their number of points and the least one, so that copies aren't paired."""
    return points.filter(spatial.finite(*"xyz")).groupBy(*PLACE).agg(F.count("*").alias("n"), F.min("point_id").alias("first"))


def neighbour_gaps(held: DataFrame, most: float) -> DataFrame:
    """(scan_id, d, n): how many points have their nearest neighbour at d, up to ``most``; of ``places``."""
    p = held.withColumnRenamed("first", "point_id")
    near = spatial.nearest(p.filter("n = 1"), p, 1, spatial.fitting_reach(p, most, 4), most=most)
    copies = held.filter("n > 1").select("scan_id", F.lit(0.0).alias("d"), "n")
    return near.select("scan_id", "d", F.lit(1).cast("bigint").alias("n")).union(copies)


def _apart() -> Column:
    d = [(F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "xyz"]
    return F.sqrt(d[0] + d[1] + d[2])


def _around(cells: DataFrame, keys: list[str], steps: list[tuple[int, int, int]]) -> DataFrame:
    """``cells`` once for each of ``steps``, moved by it."""
    s = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("xyz", step))) for step in steps)))
    return cells.withColumn("_s", s).select(*(F.col(c) if c not in keys[1:] else (F.col(c) + F.col(f"_s.{c[1]}")).alias(c) for c in cells.columns))


def _met(own: DataFrame, others: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """Places of ``own`` (as ax, ay, az) with those of ``others`` that are within the radius in the wide cells at ``steps``."""
    a = own.select("scan_id", "eps", *(F.col(c).alias(f"a{c}") for c in "xyz"), *WIDE[1:])
    b = others.select(*WIDE, *"xyz", *(c for c in ("n", "cluster") if c in others.columns))
    return _around(a, WIDE, steps).join(b, WIDE).filter(_apart() <= F.col("eps"))


def _counted(own: DataFrame, others: DataFrame, least: int, steps: list[tuple[int, int, int]]) -> DataFrame:
    """Places of ``own`` with ``least`` points or more within the radius, in the wide cells at ``steps``."""
    n = _met(own, others, steps).groupBy("scan_id", "ax", "ay", "az").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return n.select("scan_id", *(F.col(f"a{c}").alias(c) for c in "xyz"))


HERE, ALL = [(0, 0, 0)], list(product((-1, 0, 1), repeat=3))


def _core(p: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(core places, the others). A small cell's diagonal is under the radius: with ``least`` points all are core.

    Points of emptier cells are counted, first in their own wide cell, and
    those that lack neighbours there in the cells around as well.
    """
    full = p.groupBy(*SMALL).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(*SMALL)
    crowded, rest = p.join(full, SMALL, "left_semi"), settled(p.join(full, SMALL, "left_anti"))
    soon = settled(_counted(rest, p, least, HERE))
    open_ = settled(rest.join(soon, PLACE, "left_anti"))
    late = settled(_counted(open_, p, least, ALL))
    core = settled(crowded.unionByName(rest.join(soon.union(late), PLACE, "left_semi")))
    return core, settled(open_.join(late, PLACE, "left_anti"))


def _linked(core: DataFrame) -> DataFrame:
    """(small cell, cluster): cells of core places that are joined within the radius, named by their least point.

    All places of a small cell are joined. The least places of adjacent cells
    settle most of it; then cells outside their scan's largest part are
    measured in full against those of other parts, up to two cells away.
    """
    cells = settled(core.groupBy(*SMALL).agg(F.min_by(F.struct("first", *"xyz"), "first").alias("p"), F.first("eps").alias("eps")).select(*SMALL, "eps", F.col("p.first").alias("node"), *(F.col(f"p.{c}").alias(c) for c in "xyz")))
    half = [s for s in ALL if s > (0, 0, 0)]
    told = _around(cells.select(*SMALL, "eps", F.col("node").alias("a"), *(F.col(c).alias(f"a{c}") for c in "xyz")), SMALL, half)
    near = told.join(cells.select(*SMALL, F.col("node").alias("b"), *"xyz"), SMALL).filter(_apart() <= F.col("eps"))
    parts = graph.components(cells.select(F.col("scan_id").alias("scope"), "node"), near.select(F.col("scan_id").alias("scope"), "a", "b"))
    parts = settled(cells.select(*SMALL, "node").join(parts.withColumnRenamed("scope", "scan_id"), ["scan_id", "node"]).select(*SMALL, F.col("component").alias("part")))
    size = parts.groupBy("scan_id", "part").agg(F.count("*").alias("size"))
    main = size.groupBy("scan_id").agg(F.max_by("part", F.struct("size", "part")).alias("part"))
    far = [s for s in product((-2, -1, 0, 1, 2), repeat=3) if s != (0, 0, 0)]
    own = parts.join(main, ["scan_id", "part"], "left_anti").select(*SMALL, *(F.col(c).alias(f"a{c}") for c in SMALL[1:]), F.col("part").alias("a"))
    pairs = _around(own, SMALL, far).join(parts.withColumnRenamed("part", "b"), SMALL).filter("a <> b")
    left = core.select("scan_id", *(F.col(c).alias(f"a{c}") for c in (*SMALL[1:], *"xyz")), "eps")
    met = pairs.join(left, ["scan_id", *(f"a{c}" for c in SMALL[1:])]).join(core.select(*SMALL, *"xyz"), SMALL).filter(_apart() <= F.col("eps"))
    whole = graph.components(parts.select(F.col("scan_id").alias("scope"), F.col("part").alias("node")), met.select(F.col("scan_id").alias("scope"), "a", "b").distinct())
    named = whole.select(F.col("scope").alias("scan_id"), F.col("node").alias("part"), F.col("component").alias("cluster"))
    return parts.join(named, ["scan_id", "part"]).select(*SMALL, "cluster")


def clusters(points: DataFrame, held: DataFrame, radius: DataFrame, least: int) -> DataFrame:
    """(scan_id, point_id, core, cluster) as of ``graph.dbscan``, with a radius for each scan.

    ``held`` are the ``places`` of ``points``, ``radius`` has (scan_id, eps).
    Rows and disk grow with the places, not with the pairs within the radius.
    """
    # a wide cell is a hair wider than the radius: rounding moves no neighbour out of the cells around
    wide = [F.floor(F.col(c) / (F.col("eps") * 1.000001)).alias(f"g{c}") for c in "xyz"]
    small = [F.floor(F.col(c) / (F.col("eps") / 1.75)).alias(f"s{c}") for c in "xyz"]
    p = settled(held.join(radius, "scan_id").select(*PLACE, "n", "first", "eps", *wide, *small))
    core, rest = _core(p, least)
    named = settled(core.join(_linked(core), SMALL).select(*WIDE, *"xyz", "cluster"))
    beside = _met(rest, named, ALL).groupBy("scan_id", "ax", "ay", "az").agg(F.min("cluster").alias("cluster"))
    told = named.select(*PLACE, F.lit(True).alias("core"), "cluster").union(beside.select("scan_id", *(F.col(f"a{c}").alias(c) for c in "xyz"), F.lit(False), "cluster"))
    return points.select("point_id", *PLACE).join(told, PLACE, "left").select("scan_id", "point_id", F.coalesce("core", F.lit(False)).alias("core"), "cluster")
