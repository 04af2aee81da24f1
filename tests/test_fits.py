"""Fits on made clouds whose answer is known."""

import numpy as np
import pytest

from habitrace.operators import instances, planes

POINT = "scan_id long, point_id long, x double, y double, z double"


def _frame(spark, xyz, scan=1):
    return spark.createDataFrame([(scan, i, *map(float, p)) for i, p in enumerate(xyz)], POINT)


def test_similarity_with_spoilt_pairs(spark):
    rng = np.random.default_rng(1)
    p = rng.standard_normal((150, 3))
    turn = np.radians(40)
    rot = np.array([[np.cos(turn), -np.sin(turn), 0], [np.sin(turn), np.cos(turn), 0], [0, 0, 1]])
    q = 1.8 * p @ rot.T + [0.3, -2, 1]
    q[:20] += rng.random((20, 3)) * 5
    df = spark.createDataFrame([(1, *map(float, a), *map(float, b)) for a, b in zip(p, q)], "scan_id long, x double, y double, z double, u double, v double, w double")
    found = planes.similarity(df).first()
    assert found.scale == pytest.approx(1.8) and found.shift == pytest.approx([0.3, -2, 1])
    assert np.array(found.rotation).reshape(3, 3) == pytest.approx(rot)
    assert planes.similarity(df, refits=0).first().scale != pytest.approx(1.8, abs=1e-3)


def test_room_frame(spark):
    rng = np.random.default_rng(5)
    floor = np.column_stack([rng.random((500, 2)) * [5, 4], rng.normal(0, 0.004, 500)])
    wall_x = np.column_stack([rng.normal(0, 0.004, 220), rng.random(220) * 4, rng.random(220) * 2.5])
    wall_y = np.column_stack([rng.random(220) * 5, rng.normal(0, 0.004, 220), rng.random(220) * 2.5])
    clutter = rng.random((260, 3)) * [5, 4, 2]
    tilt = np.radians(8)
    rot = np.array([[1, 0, 0], [0, np.cos(tilt), -np.sin(tilt)], [0, np.sin(tilt), np.cos(tilt)]])
    df = _frame(spark, np.vstack([floor, wall_x, wall_y, clutter]) @ rot.T)
    up = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "scan_id long, ux double, uy double, uz double")
    r = planes.room_frame(df, up, trials=400).first()
    assert abs(np.array([r.nx, r.ny, r.nz]) @ rot[:, 2]) > 0.995 and r.nz > 0
    axis = np.array([r.ax, r.ay, r.az])
    assert max(abs(axis @ rot[:, 0]), abs(axis @ rot[:, 1])) > 0.98 and abs(axis @ [r.nx, r.ny, r.nz]) < 1e-6
    assert (r.method, r.confidence) == ("manhattan_walls", "high") and r.ratio > 0.3
    steep = spark.createDataFrame([(1, 1.0, 0.0, 0.0)], "scan_id long, ux double, uy double, uz double")
    assert planes.room_frame(df, steep, trials=60).filter("abs(nz) > 0.9").count() == 0


def test_floor_plane(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((300, 2)) * 4
    z = 0.1 * xy[:, 0] - 0.05 * xy[:, 1] + 0.7
    z[:20] += 2.0
    r = planes.floor_plane(_frame(spark, np.column_stack([xy, z]))).first()
    first = np.linalg.lstsq(np.column_stack([xy, np.ones(300)]), z, rcond=None)[0]
    off = abs(np.column_stack([xy, np.ones(300)]) @ first - z)
    keep = off <= np.quantile(off, 0.9)
    want = np.linalg.lstsq(np.column_stack([xy, np.ones(300)])[keep], z[keep], rcond=None)[0]
    assert [r.a, r.b, r.c] == pytest.approx(want) and r.slope == pytest.approx(np.hypot(*want[:2]))


def _block(rng, n, size, at):
    return rng.random((n, 3)) * size + at


def test_robust_geometry_and_fit(spark):
    rng = np.random.default_rng(3)
    main = _block(rng, 600, [2.0, 1.0, 0.5], [0, 0, 0])
    far = _block(rng, 60, [0.2, 0.2, 0.2], [4, 4, 0])
    df = _frame(spark, np.vstack([main, far]))
    r = instances.robust(df).first()
    assert (r.length, r.width) == (pytest.approx(2.0, abs=0.1), pytest.approx(1.0, abs=0.1))
    assert r.n == 660 and 0.8 < r.stability < 0.92 and r.high - r.low == pytest.approx(0.5, abs=0.05)
    clouds = df.unionByName(_frame(spark, _block(rng, 300, [1, 1, 0.4], [0, 0, 1.5]), 2)).unionByName(_frame(spark, _block(rng, 20, [1, 1, 1], [0, 0, 0]), 3)).unionByName(_frame(spark, _block(rng, 300, [1, 0.01, 1], [0, 0, 0]), 4))
    got = {r.scan_id: r for r in instances.fitted(clouds).collect()}
    assert {k: v.reason for k, v in got.items()} == {1: None, 2: "floating", 3: "too_few_points", 4: "degenerate"}
    assert got[1].status == "verified" and 0.9 < got[1].confidence <= 1


def test_fit_in_boxes(spark):
    rng = np.random.default_rng(6)
    df = _frame(spark, np.vstack([_block(rng, 400, [2.0, 1.0, 0.5], [1, 1, 0.1]), _block(rng, 60, [0.3, 0.3, 0.3], [1.0, 2.35, 0.1])]))
    boxes = spark.createDataFrame([(1, 7, 2.0, 1.6, 0.4, 2.4, 1.8, 1.0, 0.0)], "scan_id long, box_id long, cx double, cy double, cz double, sx double, sy double, sz double, yaw double")
    room = spark.createDataFrame([(1, 0.95, 6.0, 0.0, 6.0)], "scan_id long, lo_x double, hi_x double, lo_y double, hi_y double")
    r = instances.fit_in_boxes(df, boxes, room).first()
    # the wall at 0.95 takes the face that ends just short of it
    assert r.cx - r.sx / 2 == pytest.approx(0.95, abs=1e-6) and r.sx == pytest.approx(2.0, abs=0.1) and r.sy == pytest.approx(1.0, abs=0.1)
