"""Spatial and graph operators against brute force, and their invariances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitrace.operators import graph, scale, spatial
from habitrace.functions import text
from habitrace.sources import layout_text


def _cloud(spark, n=80, seed=3, turn=0.0, shift=0.0):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1, 1, (n, 3))
    c, s = math.cos(turn), math.sin(turn)
    rows = [(i % 2, i, float(c * x - s * y + shift), float(s * x + c * y + shift), float(z)) for i, (x, y, z) in enumerate(p)]
    return rows, spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double")


def test_radius_pairs(spark):
    rows, points = _cloud(spark)
    got = {(r.a, r.b) for r in spatial.radius_pairs(points, 0.5).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and math.dist(a[2:], b[2:]) <= 0.5}
    assert got == want


@pytest.mark.parametrize("turn,shift", [(0.7, 5.0), (0.0, -3.25)])
def test_components_do_not_move(spark, turn, shift):
    def run(points):
        pairs = spatial.radius_pairs(points, 0.45)
        nodes = points.select(F.col("scan_id").alias("scope"), F.col("point_id").alias("node"))
        return {(r.node, r.component) for r in graph.components(nodes, pairs.select(F.col("scan_id").alias("scope"), "a", "b")).collect()}

    assert run(_cloud(spark)[1]) == run(_cloud(spark, turn=turn, shift=shift)[1])


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([(1, 5), (1, 7)], "scope long, node long")
    edges = spark.createDataFrame([], "scope long, a long, b long")
    assert {(r.node, r.component) for r in graph.components(nodes, edges).collect()} == {(5, 5), (7, 7)}


def test_box_margins(spark):
    points = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0), (1, 2, 1.2, 0.0, 0.0), (1, 3, 0.0, 1.0, 0.0)], "scan_id long, point_id long, x double, y double, z double")
    boxes = spark.createDataFrame([(1, 9, 0.0, 0.0, 0.0, 2.0, 0.2, 1.0, 0.0)], "scan_id long, box_id long, cx double, cy double, cz double, sx double, sy double, sz double, yaw double")
    got = {r.point_id for r in spatial.points_in_boxes(points, boxes, (0.1, 0.0, 0.0), 0.4).collect()}
    assert got == {1}
    turned = boxes.withColumn("yaw", F.lit(math.pi / 2))
    assert {r.point_id for r in spatial.points_in_boxes(points, turned, (0.1, 0.0, 0.0), 0.4).collect()} == {3}


def test_grid_distances(spark):
    wall = {(r, 2) for r in range(4)}
    free = [(1, r, c) for r in range(5) for c in range(5) if (r, c) not in wall]
    cells = spark.createDataFrame(free, "scan_id long, row long, col long")
    seed = spark.createDataFrame([(1, 0, 0)], "scan_id long, row long, col long")
    got = {(r.row, r.col): r.dist for r in graph.grid_distances(cells, seed, graph.FOUR).collect()}
    assert got[(0, 4)] == 12.0 and len(got) == len(free)


def test_consensus_needs_two(spark):
    rows = [(1, 1, 1.0), (1, 2, 1.1), (1, 3, 5.0), (2, 1, 1.0)]
    got = {r.key: r for r in scale.consensus_scale(spark.createDataFrame(rows, "key long, i long, v double"), "key", "v", "i").collect()}
    assert got[1].used == 2 and got[1].scale == pytest.approx(1.05)
    assert got[2].scale is None


def test_layout_skips_malformed(spark):
    lines = ["wall_0=Wall(0, 0, 0, 4, 0, 0, 2.5, 0.1)", "door_0=Door(wall_0, 1, 0, 1, 0.9, 2)", "door_1=Door(wall_7, 1, 0, 1, 0.9, 2)", "wall_1=Wall(0, 0, x)", "nonsense", None]
    parsed = layout_text.parse_layout(spark.createDataFrame([(1, line) for line in lines], "scan_id long, line string"))
    walls = layout_text.walls(parsed)
    assert [(r.item_id, r.bx, r.height) for r in walls.collect()] == [(0, 4.0, 2.5)]
    assert [(r.item_id, r.wall_id, r.width) for r in layout_text.openings(parsed, walls, ["scan_id"]).collect()] == [(0, 0, 0.9)]


def test_text_functions(spark):
    df = spark.createDataFrame([("token=abc&x=1 n 3/4", "a/b/c.txt", None), (None, "c.txt", 2.675)], "line string, path string, v double")
    got = df.select(text.redacted(F.col("line")).alias("r"), text.progress(F.col("line")).alias("p"), text.safe_filename(F.col("path")).alias("f"), text.shown(F.col("v")).alias("s")).collect()
    assert got[0].r == "token=***&x=1 n 3/4" and got[0].p == 0.75 and got[0].f == "c.txt" and got[0].s == "-"
    assert got[1].r is None and got[1].p is None and got[1].f == "c.txt"
