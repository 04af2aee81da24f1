"""Completed surfaces and homographies, planted and against brute force."""

import numpy as np

from habitrace.operators import completion, matching
from habitrace.plans import registry

CANDIDATE = "query_id long, ref_id long, key_id long, other_id long, distance double, x double, y double, u double, v double"


def test_planted_homographies(spark):
    """Four in ten matches are wrong; the other pairs are too few, in line, or have no homography."""
    rng = np.random.default_rng(5)
    planted = {1: np.array([[0.9, 0.1, 12], [-0.05, 1.1, -7], [2e-4, -1e-4, 1]]), 2: np.array([[1.2, -0.3, 40], [0.25, 0.8, 5], [-3e-4, 1e-4, 1]])}
    rows, good = [], {}
    for ref, h in planted.items():
        xy = rng.random((250, 2)) * [640, 480]
        to = np.column_stack([xy, np.ones(250)]) @ h.T
        uv = to[:, :2] / to[:, 2:] + rng.normal(0, 0.5, (250, 2))
        wrong = rng.random(250) < 0.4
        uv[wrong] = rng.random((wrong.sum(), 2)) * [640, 480]
        good[ref] = int((~wrong).sum())
        rows += [(9, ref, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(xy, uv))]
    noise = rng.random((120, 4)) * 600
    rows += [(9, 3, i, *map(float, r)) for i, r in enumerate(noise)] + [(9, 4, i, *map(float, r)) for i, r in enumerate(noise[:7])]
    rows += [(9, 5, i, float(i), 2.0 * i, float(i), 3.0 * i) for i in range(30)] + [(9, 6, i, 1.0, 2.0, 3.0, None) for i in range(30)]
    m = spark.createDataFrame(rows, "query_id long, ref_id long, key_id long, x double, y double, u double, v double")
    found = matching.homographies(m)
    got = {r.ref_id: r for r in found.collect()}
    for ref, h in planted.items():
        assert got[ref].matches == 250 and 0.9 * good[ref] <= got[ref].inliers <= good[ref] + 12
        own = np.array(got[ref].h).reshape(3, 3)
        corners = np.array([(0, 0, 1), (640, 0, 1), (640, 480, 1), (0, 480, 1), (320, 240, 1)], float)
        a, b = (corners @ x.T for x in (own, h))
        assert abs(a[:, :2] / a[:, 2:] - b[:, :2] / b[:, 2:]).max() < 25
        # the count is what brute force over the matches gives
        own_rows = np.array([r[3:] for r in rows if r[1] == ref])
        assert got[ref].inliers == matching._agreeing(own.ravel(), own_rows, matching.ERROR).sum()
    assert got[3].inliers < 15 and (got[4].matches, got[4].inliers, got[4].h) == (7, 0, None)
    assert (got[5].inliers, got[5].h) == (0, None) and 6 not in got
    assert matching.anchors(found).collect()[0].ref_id == max(planted, key=lambda k: got[k].inliers)
    assert matching.anchors(found.filter("ref_id in (4, 5)")).count() == 0 and matching.homographies(m.limit(0)).count() == 0


def test_many_blocks(spark, monkeypatch):
    """Votes of several blocks add up to those of one."""
    rng = np.random.default_rng(6)
    xy = rng.random((90, 2)) * 500
    rows = [(1, 1, i, *map(float, (*p, *(p * 1.1 + 3)))) for i, p in enumerate(xy)]
    m = spark.createDataFrame(rows, "query_id long, ref_id long, key_id long, x double, y double, u double, v double")
    whole = matching.homographies(m, trials=20).first()
    monkeypatch.setattr(matching, "BLOCK", 16)
    assert matching.homographies(m, trials=20).first() == whole and whole.inliers == 90


def test_ratio(spark):
    rows = [(1, 1, k, o, d, 1.0, 2.0, 3.0, 4.0) for k, ds in enumerate([[10, 20], [15, 20], [14.3, 20], [5], [8, 8, 30], [9, 40, 12.4], [0, 0.1]]) for o, d in enumerate(ds)]
    got = {r.key_id for r in matching.good_matches(spark.createDataFrame([tuple(float(v) if i == 4 else v for i, v in enumerate(r)) for r in rows], CANDIDATE)).collect()}
    assert got == {0, 2, 6}


def test_best_reference_of_the_tables(spark, sf_dir):
    pairs = registry.queries()["image_pairs"](spark, sf_dir).collect()
    share = lambda k: np.mean([r.inliers / r.matches for r in pairs if r.ref_id == k])
    assert share(0) > 0.5 > share(1) > share(2)
    assert {r.ref_id for r in registry.queries()["image_anchors"](spark, sf_dir).collect()} == {0}


def test_walls_and_floor_filled(spark):
    """A wall seen in part, with a door and a window: every empty cell once, none in the door, colours from the nearest."""
    rng = np.random.default_rng(9)
    cell, length, height = 0.1, 3.0, 2.0
    seen = np.column_stack([rng.uniform(-1.5, -0.2, 500), rng.random(500) * 2])
    a = np.radians(30)
    tangent, wall = np.array([np.cos(a), np.sin(a)]), np.array([1.0, 2.0])
    off = rng.normal(0, 0.02, 500)
    xyz = np.column_stack([wall + seen[:, :1] * tangent + off[:, None] * [-np.sin(a), np.cos(a)], seen[:, 1]])
    points = [(1, i, *map(float, p), int(p[2] * 10)) for i, p in enumerate(xyz)] + [(1, 900, 50.0, 50.0, 1.0, 7), (1, 901, None, 0.0, 0.0, 7)]
    p = spark.createDataFrame(points, "scan_id long, point_id long, x double, y double, z double, colour long")
    sides = spark.createDataFrame([(1, 4, 1.0, 2.0, float(a), length, height)], "scan_id long, wall_id long, wx double, wy double, yaw double, length double, height double")
    doors = spark.createDataFrame([(1, 4, "door", 0.4, 0.0, 0.5, 1.5), (1, 4, "window", 1.1, 0.8, 0.3, 0.5), (1, 5, "door", 0.0, 0.0, 9.0, 9.0)], "scan_id long, wall_id long, kind string, along double, bottom double, width double, height double")
    taken = {(int(np.floor((float((q[:2] - wall) @ tangent) + 1.5) / cell)), int(np.floor(float(q[2]) / cell))) for q, o in zip(xyz, off) if abs(o) <= 0.075}
    want = {}
    for i in range(30):
        for j in range(20):
            u, v = -1.5 + (i + 0.5) * cell, (j + 0.5) * cell
            if (i, j) not in taken and not (abs(u - 0.4) <= 0.33 and -0.08 <= v <= 1.58):
                want[i, j] = abs(u - 1.1) <= 0.23 and 0.72 <= v <= 1.38
    got = {}
    for r in completion.walls(p, sides, doors, cell).collect():
        q = np.array([r.x, r.y]) - wall
        assert abs(q @ [-np.sin(a), np.cos(a)]) < 1e-9
        at = (int(np.floor((q @ tangent + 1.5) / cell)), int(np.floor(r.z / cell)))
        assert at not in got
        got[at] = r.window
        d = np.hypot(seen[:, 0] - q @ tangent, seen[:, 1] - r.z)
        assert r.colour == int(xyz[d[abs(off) <= 0.075].argmin() if (abs(off) <= 0.075).all() else np.flatnonzero(abs(off) <= 0.075)[d[abs(off) <= 0.075].argmin()], 2] * 10)
    assert got == want and any(want.values())
    again = completion.walls(p, sides, doors, cell).collect()
    assert len(again) == len(want) and completion.walls(p.limit(0), sides, doors.limit(0), cell).filter("colour is null").count() == 600
    rooms = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.8), (2, 0.0, 1.0, 0.0, 1.0)], "scan_id long, lo_x double, hi_x double, lo_y double, hi_y double")
    low = spark.createDataFrame([(1, i, 0.05 + 0.1 * (i % 5), 0.05, 0.01, 3) for i in range(120)] + [(2, i, 0.5, 0.5, 0.0, 1) for i in range(99)], "scan_id long, point_id long, x double, y double, z double, colour long")
    found = completion.floors(low, rooms, cell).collect()
    cells = {(int(np.floor(r.x / cell)), int(np.floor(r.y / cell))) for r in found}
    assert len(found) == len(cells) and cells == {(i, j) for i in range(10) for j in range(8)} - {(k, 0) for k in range(5)}
    assert {(r.scan_id, r.z, r.colour) for r in found} == {(1, 0.0, 3)}
