"""Connected components, clustering and paths as iterated joins.

Frontiers and labels are DataFrames, one round is a join and an aggregation,
and lineage is cut by reliable checkpoints; only a count per round reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.session import settled


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, node, component): least node reachable within a scope.

    ``nodes`` (scope, node), ``edges`` (scope, a, b), read in both directions.
    Each round takes the least label of the neighbours, then that label's own
    label (pointer jumping), so rounds grow with the logarithm of the diameter
    on usual graphs.
    """
    both = settled(edges.select("scope", "a", "b").union(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(nodes.select("scope", "node", F.col("node").alias("component")).distinct())
    while True:
        told = both.join(labels.select("scope", F.col("node").alias("b"), F.col("component").alias("offer")), ["scope", "b"]).groupBy("scope", F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        met = labels.join(told, ["scope", "node"], "left").select("scope", "node", F.col("component").alias("old"), F.least("component", F.coalesce("offer", "component")).alias("mid"))
        jump = met.select("scope", F.col("node").alias("mid"), F.col("mid").alias("far"))
        new = settled(met.join(jump, ["scope", "mid"], "left").select("scope", "node", F.least("mid", F.coalesce("far", "mid")).alias("component"), "old"))
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("scope", "node", "component")
        if not changed:
            return labels


def dbscan(points: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(scan_id, point_id, core, cluster): density clusters from pairs within the radius.

    A point with ``least`` neighbours or more (itself included) is core; core
    points that are neighbours share a cluster, named by its least core point;
    other points join the least cluster next to them, or none (noise, NULL).
    """
    n = pairs.groupBy("scan_id", F.col("a").alias("point_id")).agg(F.count("*").alias("n"))
    core = settled(n.filter(F.col("n") + 1 >= least).select("scan_id", "point_id"))
    near = pairs.join(core.select("scan_id", F.col("point_id").alias("b")), ["scan_id", "b"])
    inner = near.join(core.select("scan_id", F.col("point_id").alias("a")), ["scan_id", "a"], "left_semi").filter("a < b")
    found = components(core.select(F.col("scan_id").alias("scope"), F.col("point_id").alias("node")), inner.select(F.col("scan_id").alias("scope"), "a", "b"))
    clusters = found.select(F.col("scope").alias("scan_id"), F.col("node").alias("point_id"), F.col("component").alias("cluster"))
    border = near.join(clusters.select("scan_id", F.col("point_id").alias("b"), "cluster"), ["scan_id", "b"]).groupBy("scan_id", F.col("a").alias("point_id")).agg(F.min("cluster").alias("beside"))
    joined = points.select("scan_id", "point_id").join(clusters, ["scan_id", "point_id"], "left").join(border, ["scan_id", "point_id"], "left")
    return joined.select("scan_id", "point_id", F.col("cluster").isNotNull().alias("core"), F.coalesce("cluster", "beside").alias("cluster"))


def grid_distances(free: DataFrame, seeds: DataFrame, steps: list[tuple[int, int, float]], cost: str | None = None) -> DataFrame:
    """(scan_id, row, col, dist): cheapest way from the seeds over free cells.

    Each round relaxes the neighbours of the cells that became cheaper in the
    round before. ``steps`` holds (drow, dcol, length); ``cost`` names a column
    of ``free`` that multiplies the length of a step into the cell.
    """
    weight = F.col(cost) if cost else F.lit(1.0)
    cells = settled(free.select("scan_id", "row", "col", weight.alias("w")))
    keys = ["scan_id", "row", "col"]
    best = settled(seeds.join(cells, keys, "left_semi").select(*keys, F.lit(0.0).alias("dist"), F.lit(True).alias("new")))
    spread = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(d).alias("d")) for r, c, d in steps))
    while True:
        moves = best.filter("new").select("scan_id", "row", "col", "dist", F.explode(spread).alias("s")).select("scan_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "dist", F.col("s.d").alias("d"))
        offers = moves.join(cells, keys).groupBy(*keys).agg(F.min(F.col("dist") + F.col("d") * F.col("w")).alias("offer"))
        merged = best.select(*keys, "dist").join(offers, keys, "full")
        new = F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist") - 1e-12))
        best = settled(merged.select(*keys, F.when(new, F.col("offer")).otherwise(F.col("dist")).alias("dist"), new.alias("new")))
        if not best.filter("new").limit(1).count():
            return best.select(*keys, "dist")


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, node): what edges (scope, a, b; both ways) reach from ``seeds`` (scope, node)."""
    both = settled(edges.select("scope", "a", "b").union(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = front = settled(seeds.select("scope", "node").distinct())
    while not front.isEmpty():
        steps = front.join(both, (front.scope == both.scope) & (front.node == both.a)).select(front.scope, F.col("b").alias("node")).distinct()
        front = settled(steps.join(found, ["scope", "node"], "left_anti"))
        found = settled(found.union(front))
    return found


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, kept): what a greedy choice keeps that goes through the nodes from best to worst.

    ``edges`` (better, worse) say who suppresses whom and must not form a
    circle. Each round settles all nodes whose better neighbours are settled,
    so rounds are as many as the longest chain, and no group meets in one task.
    """
    open_ = settled(nodes.select("node").distinct())
    live = settled(edges.select("better", "worse").distinct())
    kept = dropped = open_.limit(0)
    while not open_.isEmpty():
        first = settled(open_.join(live.select(F.col("worse").alias("node")).distinct(), "node", "left_anti"))
        out = settled(live.join(first, live.better == first.node, "left_semi").select(F.col("worse").alias("node")).distinct())
        kept, dropped = kept.union(first), dropped.union(out)
        gone = first.union(out)
        open_ = settled(open_.join(gone, "node", "left_anti"))
        live = settled(live.join(gone.withColumnRenamed("node", "better"), "better", "left_anti").join(gone.withColumnRenamed("node", "worse"), "worse", "left_anti").select("better", "worse"))
    return kept.select("node", F.lit(True).alias("kept")).union(dropped.select("node", F.lit(False).alias("kept")))


FOUR = [(0, 1, 1.0), (1, 0, 1.0), (0, -1, 1.0), (-1, 0, 1.0)]
EIGHT = FOUR + [(1, 1, 2**0.5), (1, -1, 2**0.5), (-1, 1, 2**0.5), (-1, -1, 2**0.5)]
