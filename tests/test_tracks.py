"""Association, fragments, suppression and hulls against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitrace.operators import assignment, graph, layout, planes, tracks


def test_least_cost_assignment():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (3, 5), (5, 3), (4, 4), (6, 6)):
        cost = rng.random(shape)
        pairs = assignment.least_cost(cost)
        small, flip = min(shape), shape[0] > shape[1]
        assert len(pairs) == small and len({a for a, _ in pairs}) == small and len({b for _, b in pairs}) == small
        c = cost.T if flip else cost
        best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(c.shape[1]), c.shape[0]))
        assert sum(cost[a, b] for a, b in pairs) == pytest.approx(best)


def test_assign_groups(spark):
    a = spark.createDataFrame([(1, 10, 0.0, 0.0), (1, 11, 5.0, 0.0), (2, 12, 0.0, 0.0)], "scan_id long, instance_id long, x double, y double")
    b = spark.createDataFrame([(1, 20, 4.0, 0.0), (1, 21, 1.0, 0.0), (3, 22, 0.0, 0.0)], "scan_id long, track_id long, x double, y double")
    assert sorted((r.instance_id, r.track_id) for r in assignment.assign(a, b, ["scan_id"]).collect()) == [(10, 21), (11, 20)]


def test_veto():
    conflicts = {frozenset((1, 3))}
    root = tracks.merge_with_veto([1, 2, 3, 4], [(1, 2), (2, 3), (3, 4)], conflicts)
    assert root[1] == root[2] and root[3] == root[4] and root[1] != root[3]


def test_association(spark):
    o = spark.createDataFrame([("g", 1, 1, 1), ("g", 2, 2, 2), ("g", 3, 2, 2), ("g", 4, 3, 3)], "grp string, obs_id long, frame_id long, frame_order long")
    see = {1: range(10), 2: range(2, 10), 3: range(20, 30), 4: range(18, 30)}
    b = spark.createDataFrame([("g", k, p) for k, ps in see.items() for p in ps], "grp string, obs_id long, point_id long")
    e = tracks.pair_evidence(o, b, ["grp"])
    assert {(r.a, r.b): (r.accepted, r.conflict) for r in e.collect()} == {(1, 2): (True, False), (2, 3): (False, True), (3, 4): (True, False)}
    assert {r.obs_id: r.track for r in tracks.associate(o, e, ["grp"]).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_semantic_veto_of_fragments(spark):
    frags = spark.createDataFrame([(1, f, 10 * f + k, float(f), 0.0, 0.0) for f in (1, 2, 3) for k in range(5)], "scan_id long, fragment long, point_id long, x double, y double, z double")
    masks = spark.createDataFrame([(1, m, m, 10 * f + k) for m in (1, 2) for f in (1, 2, 3) for k in range(5)], "scan_id long, mask long, view long, point_id long")
    groups = spark.createDataFrame([(1, 1, "bed"), (1, 2, "desk")], "scan_id long, fragment long, grp string")
    got = {r.fragment: r.merged for r in tracks.merge_tracks(frags, masks, groups, "bed", 0.05).collect()}
    assert got == {1: 1, 3: 1, 2: 2}


def test_complete_link():
    rng = np.random.default_rng(6)
    xy = rng.random((40, 2)) * 3
    label = tracks.complete_link(xy, 0.48)
    for c in set(label):
        own = xy[label == c]
        assert max(np.hypot(*(a - b)) for a in own for b in own) <= 0.48
    far = lambda a, b: max(np.hypot(*(p - q)) for p in xy[label == a] for q in xy[label == b])
    assert all(far(a, b) > 0.48 for a, b in itertools.combinations(set(label), 2))
    assert list(tracks.complete_link(np.array([[0.0, 0.0]]), 0.5)) == [0]


def test_ordered_exclusion(spark):
    objects = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 2.0, 2.0, 0.0), (1, 2, 2, 3.0, 0.0, 2.0, 2.0, 0.0), (1, 3, 3, 1.5, 0.0, 9.0, 9.0, 0.0)], "scan_id long, object_id long, rank long, cx double, cy double, sx double, sy double, yaw double")
    places = [(1, 3, i, x, 0.0) for i, x in enumerate([0.0] * 4 + [3.0] * 4 + [6.0] * 3)]
    points = spark.createDataFrame(places, "scan_id long, object_id long, point_id long, x double, y double")
    kept = lambda least: sorted(r.point_id for r in tracks.exclude_footprints(points, objects, 0.1, least).collect())
    assert kept(2) == [8, 9, 10]
    # the second cut would leave three points only, so it isn't made
    assert kept(3) == [4, 5, 6, 7, 8, 9, 10]
    assert kept(50) == list(range(11))


def test_greedy_keep(spark):
    rng = np.random.default_rng(1)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 60, (90, 2)) if a < b}
    kept = set()
    for n in range(60):
        if not any((k, n) in edges for k in kept):
            kept.add(n)
    nodes = spark.range(60).withColumnRenamed("id", "node")
    got = graph.greedy_keep(nodes, spark.createDataFrame(sorted(edges), "better long, worse long"))
    assert {r.node for r in got.filter("kept").collect()} == kept and got.count() == 60


def test_suppression_of_boxes(spark, sf_dir):
    from habitrace.sources.driver_tables import boxes

    rows = layout.footprint(boxes(spark, sf_dir)).collect()
    got = {r.box_id: r.kept for r in layout.suppressed(boxes(spark, sf_dir), 0.5, 0.5).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r.score, r.box_id)):
        def iou(o, r=r):
            w, h = min(r.x1, o.x1) - max(r.x0, o.x0), min(r.y1, o.y1) - max(r.y0, o.y0)
            inter = max(w, 0) * max(h, 0)
            return inter / ((r.x1 - r.x0) * (r.y1 - r.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - inter)

        if not any(o.scan_id == r.scan_id and o.label == r.label and iou(o) > 0.5 for o in kept):
            kept.append(r)
    assert {b for b, k in got.items() if k} == {r.box_id for r in kept} and len(got) == len(rows)


def test_hull_and_rectangle(spark):
    rng = np.random.default_rng(3)
    turn = np.radians(33)
    xy = rng.random((400, 2)) * [4, 1] - [2, 0.5]
    xy = np.vstack([xy, [[-2, -0.5], [2, -0.5], [2, 0.5], [-2, 0.5]]]) @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in xy] + [(2, 0.0, 0.0)], "g long, x double, y double").repartition(5)
    got = {r.g: r for r in planes.min_area_rectangles(df, ["g"]).collect()}
    assert (got[1].length, got[1].width) == pytest.approx((4, 1)) and got[1].angle == pytest.approx(turn)
    assert (got[2].length, got[2].width) == (0, 0)


def test_widest_pairs(spark):
    rng = np.random.default_rng(8)
    xyz = rng.standard_normal((300, 3))
    xyz /= np.linalg.norm(xyz, axis=1)[:, None]
    df = spark.createDataFrame([(k % 2, *map(float, p)) for k, p in enumerate(xyz)], "scan_id long, x double, y double, z double")
    for scan in (0, 1):
        own = xyz[scan::2]
        want = max(np.linalg.norm(a - b) for a in own for b in own)
        assert df.filter(F.col("scan_id") == scan).transform(planes.widest_pairs).first().widest == pytest.approx(want)


def test_ransac_finds_the_plane(spark):
    rng = np.random.default_rng(11)
    flat = np.column_stack([rng.random((120, 2)) * 4, rng.normal(1.0, 0.005, 120)])
    noise = rng.random((280, 3)) * 4
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(np.vstack([flat, noise]))], "scan_id long, point_id long, x double, y double, z double")
    best = planes.ransac(df, trials=500, threshold=0.03).first()
    assert abs(best.nz) > 0.99 and best.inliers >= 115 and abs(abs(best.d) - 1.0) < 0.05
    away = abs(np.vstack([flat, noise]) @ [best.nx, best.ny, best.nz] - best.d)
    assert best.inliers == int((away <= 0.03).sum())
