"""Planted cameras, splats byte by byte and wall strips against plain walks."""

import math
import struct

import numpy as np
import pytest

from habitrace.operators import poses, splats, strips

SEEN = "scan_id long, frame_id long, point_id long, u double, v double, x double, y double, z double, conf double"
FIRST = "scan_id long, frame_id long, focal double, inliers long, error double, sharpness double, accepted boolean, reason string"


def _turn(axis):
    size = np.linalg.norm(axis)
    x, y, z = np.array(axis) / size
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(size) * k + (1 - np.cos(size)) * k @ k


def _frame(rng, frame, n, wrong, flat=False, noise=0.3, focal=280.0):
    turn, shift = _turn(rng.normal(0, 0.5, 3)), np.array([*rng.normal(0, 0.3, 2), rng.uniform(4, 6)])
    world = rng.uniform(-1, 1, (n, 3))
    if flat:
        world[:, 2] = 0.4
    at = world @ turn.T + shift
    pixels = focal * at[:, :2] / at[:, 2:] + 112 + rng.normal(0, noise, (n, 2))
    off = rng.random(n) < wrong
    pixels[off] = rng.uniform(0, 224, (off.sum(), 2))
    return [(1, frame, k, *map(float, p), *map(float, w), 20.0) for k, (p, w) in enumerate(zip(pixels, world))], turn, shift, int((~off).sum())


def test_planted_cameras(spark):
    """Four in ten pixels are wrong; a wall is a plane; other frames lack pixels, agreement or confidence."""
    rng = np.random.default_rng(3)
    rows, planted = [], {}
    for frame, flat in ((0, False), (1, True), (2, False)):
        made, *true = _frame(rng, frame, 2500 if frame == 2 else 400, 0.4, flat)
        rows += made
        planted[frame] = true
    rows += _frame(rng, 3, 60, 0.0)[0]
    rows += [(1, 4, k, *map(float, r), 20.0) for k, r in enumerate(rng.uniform(0, 200, (300, 5)))]
    rows += [(*r[:-1], 12.0) for r in _frame(rng, 5, 300, 0.0)[0]]
    rows += [(1, 6, k, k % 13 * 10.0, k % 7 * 20.0, float(k), 0.0, 0.0, 20.0) for k in range(200)]
    rows += [(1, 0, 9900, None, 1.0, 1.0, 1.0, 1.0, 20.0), (1, 0, 9901, float("nan"), 1.0, 1.0, 1.0, 1.0, 20.0), (1, 0, 9902, 1.0, 1.0, float("inf"), 1.0, 1.0, None)]
    seen = spark.createDataFrame(rows, SEEN)
    got = {r.frame_id: r for r in poses.frame_poses(seen, least_points=100, least_inliers=80, trials=80).collect()}
    for frame, (turn, shift, good) in planted.items():
        r = got[frame]
        assert r.accepted and r.reason is None and good <= r.inliers <= good + 15, r
        assert abs(np.array(r.rotation).reshape(3, 3) - turn).max() < 0.02 and abs(np.array(r["shift"]) - shift).max() < 0.08
        # what is counted is what a plain walk over the frame's pixels counts
        p = np.array([x[3:8] for x in rows if x[1] == frame and x[2] < 9900])
        at = p[:, 2:] @ np.array(r.rotation).reshape(3, 3).T + np.array(r["shift"])
        off = np.hypot(*(p[:, :2] - 112 - 280 * at[:, :2] / at[:, 2:]).T)
        assert r.inliers == (off <= 4).sum() and r.error == pytest.approx(np.median(off[off <= 4]))
        assert r.focal == pytest.approx(np.median(((p[:, 0] - 112) * at[:, 2] / (at[:, 0] + 1e-9))[off <= 4]))
        assert r.points == len(p)
    assert [got[k].reason for k in (3, 4, 5, 6)] == ["few_points", "few_inliers", "few_points", "few_inliers"]
    assert (got[5].points, got[5].inliers, got[5].rotation, got[5].focal) == (0, 0, None, None)

    focals = spark.createDataFrame([(1, 300.0)], "scan_id long, focal double")
    again = poses.frame_poses(seen.filter("frame_id in (0, 3)").withColumn("x", seen.x), focals, least_points=100, least_inliers=80, focal_range=None, trials=80)
    second = {r.frame_id: r for r in again.collect()}
    assert second[0].accepted and second[0]["shift"][2] > got[0]["shift"][2] and 290 < second[0].focal < 310
    assert poses.frame_poses(seen, focals.filter("scan_id = 9"), least_points=100).count() == 0
    assert poses.frame_poses(seen.limit(0)).count() == 0
    odd = poses.frame_poses(seen.filter("frame_id = 0"), least_points=100, least_inliers=80, focal_range=(100.0, 200.0), trials=80).first()
    assert (odd.reason, odd.accepted) == ("odd_focal", False)
    blurred = poses.frame_poses(seen.filter("frame_id = 0"), least_points=100, least_inliers=80, median_error=0.1, trials=80).first()
    assert blurred.reason == "reprojection"


def test_common_focal(spark):
    rows = [(1, k, 250.0 + k, 900, 1.0, 0.0, k % 2 == 0, None if k % 2 == 0 else "reprojection") for k in range(31)]
    rows += [(1, 40, 9999.0, 900, 1.0, 0.0, False, "odd_focal"), (1, 41, None, 0, None, 0.0, False, "few_points")]
    rows += [(2, k, 700.0, 900, 1.0, 0.0, True, None) for k in range(30)] + [(3, k, 300.0, 900, 1.0, 0.0, True, None) for k in range(29)]
    got = {r.scan_id: (r.frames, r.focal) for r in poses.common_focal(spark.createDataFrame(rows, FIRST)).collect()}
    assert got == {1: (31, 265.0), 2: (30, 420.0), 3: (29, None)}


def _walk_of_time(frames, most):
    """Primary and backup frames, one after the other."""
    if len(frames) <= most:
        return [f[0] for f in frames], []
    edges = [int(k * len(frames) / most) for k in range(most)] + [len(frames)]
    first = [max(frames[a:b], key=lambda f: f[1])[0] for a, b in zip(edges, edges[1:])]
    return sorted(first), [f[0] for f in sorted((f for f in frames if f[0] not in first), key=lambda f: -f[1])]


@pytest.mark.parametrize("most", [0, 1, 4, 7, 23, 40])
def test_spread_over_time(spark, most):
    rng = np.random.default_rng(most)
    rows = []
    for scan in range(1, 4):
        for k in range((23, 9, 4)[scan - 1]):
            rows.append((scan, 3 * k, 300.0, int(rng.integers(800, 805)), float(rng.integers(0, 3)) / 2, float(rng.integers(0, 2) * 50), k % 6 != 5, None if k % 6 != 5 else "few_inliers"))
    found = poses.spread_over_time(spark.createDataFrame(rows, FIRST), most)
    got = sorted((r.scan_id, r.role, r["rank"], r.frame_id) for r in found.collect())
    want = []
    for scan in range(1, 4):
        frames = [(r[1], 0.25 * math.log1p(r[5]) + 0.15 * math.log1p(r[3]) - r[4]) for r in rows if r[0] == scan and r[6]]
        first, rest = _walk_of_time(frames, most) if most else ([], [f[0] for f in frames])
        want += [(scan, "primary", k + 1, f) for k, f in enumerate(first)] + [(scan, "backup", k + 1, f) for k, f in enumerate(rest)]
    assert got == sorted(want)


def test_cameras(spark):
    rng = np.random.default_rng(8)
    own, shift, turn = {k: _turn(rng.normal(size=3)) for k in range(6)}, {k: rng.normal(size=3) for k in range(6)}, _turn([0.3, -0.2, 0.9])
    second = spark.createDataFrame([(1, k, 300.0, 900, 1.0, own[k].ravel().tolist(), shift[k].tolist(), k != 1) for k in range(6)] + [(2, 0, 300.0, 900, 1.0, own[0].ravel().tolist(), shift[0].tolist(), True)], "scan_id long, frame_id long, focal double, inliers long, error double, rotation array<double>, shift array<double>, accepted boolean")
    choice = spark.createDataFrame([(1, 0, "primary", 1), (1, 1, "primary", 2), (1, 4, "primary", 3), (1, 5, "backup", 1), (1, 2, "backup", 2), (1, 3, "backup", 3), (2, 0, "primary", 1)], "scan_id long, frame_id long, role string, rank long")
    aligned = spark.createDataFrame([(s, turn.ravel().tolist(), 1.7, 0.3) for s in (1, 2)], "scan_id long, turn array<double>, scale double, floor double")
    got = {r.frame_id: r for r in poses.cameras(second, choice, aligned, 4, 2).collect()}
    assert set(got) == {0, 4, 5, 2} and all(r.scan_id == 1 for r in got.values())
    for k, r in got.items():
        assert np.allclose(np.array(r.rotation).reshape(3, 3), own[k] @ turn.T)
        assert np.allclose(r.position, -1.7 * (np.array([0, 0, 0.3]) + turn @ own[k].T @ shift[k]))


SPLAT = "scan_id long, splat_id long, " + ", ".join(f"{c} double" for c in splats.NUMBERS)


def test_splats(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 3, k, *map(float, rng.normal(0.4, 0.5, 14))) for k in range(500)]
    rows += [(0, 500, *[0.0] * 14), (1, 501, *[1.0] * 14), (2, 502, *[-9.0] * 14)]
    odd = [(0, 600, *[float("nan")] * 14), (0, 601, None, *[1.0] * 13), (1, 602, *[1.0] * 13, float("-inf")), (None, 5, *[1.0] * 14), (0, None, *[1.0] * 14)]
    made = spark.createDataFrame(rows + odd, SPLAT)
    want = {}
    for scan, at, *n in rows:
        size = max(math.sqrt(sum(q * q for q in n[7:11])), 1e-12)
        small = [min(max(v * 255, 0), 255) for v in (*n[11:], n[6])] + [min(max(q / size * 128 + 128, 0), 255) for q in n[7:11]]
        want.setdefault(scan, []).append((at, struct.pack("<6f8B", *n[:6], *map(int, small))))
    got = {(r.scan_id, r.splat_id): bytes(r.record) for r in splats.records(made.filter("scan_id is not null and splat_id is not null"), ["scan_id", "splat_id"]).collect()}
    assert got == {(s, at): b for s, each in want.items() for at, b in each} and {len(b) for b in got.values()} == {32}
    back = splats.round_trip(made, part=40).orderBy("scan_id", "place").collect()
    names = [*splats.CENTRE, *splats.SCALE, *splats.BYTES]
    for scan, each in want.items():
        own = [r for r in back if r.scan_id == scan]
        assert [r.place for r in own] == list(range(len(each)))
        assert [struct.pack("<6f8B", *(r[c] for c in names)) for r in own] == [b for _, b in sorted(each)]
    assert len(back) == len(rows) and splats.round_trip(made.limit(0)).count() == 0

    web = {(r.scan_id, r.splat_id): r for r in splats.web_parameters(spark.createDataFrame(rows + odd[1:2], SPLAT)).collect()}
    for scan, at, *n in rows:
        r = web[scan, at]
        o = min(max(n[6], 1e-6), 1 - 1e-6)
        assert [r.scale_0, r.scale_1, r.scale_2, r.opacity] == pytest.approx([*(math.log(max(v, 1e-12)) for v in n[3:6]), math.log(o / (1 - o))])
        assert [r.rot_0, r.rot_1, r.rot_2, r.rot_3] == [*n[8:11], n[7]] and [r.x, r.f_dc_2] == [n[0], n[13]]
    assert web[0, 601].x is None and len(web) == len(rows) + 1


def _walk_of_walls(p, lo, hi, far, top, length, span, start, cell, least, stay):
    gone = set()
    for axis, side in ((0, 0), (0, 1), (1, 0), (1, 1)):
        depth = p[:, axis] - lo[axis] if side == 0 else hi[axis] - p[:, axis]
        band = (depth >= 0.03) & (depth <= far) & (p[:, 2] <= top)
        if band.sum() < least:
            continue
        key = np.floor(p[:, 1 - axis] / cell).astype(int)
        low = {}
        for k in set(key[band]):
            z = p[band & (key == k), 2]
            if p[key == k, 2].max() <= top + 0.05 and z.max() - z.min() >= span and z.min() <= start:
                low[k] = np.flatnonzero(band & (key == k))
        for k in low:
            a = b = k
            while a - 1 in low:
                a -= 1
            while b + 1 in low:
                b += 1
            if (b - a + 1) * cell >= length:
                gone |= set(low[k].tolist())
    left = len(p) - len(gone)
    return set(range(len(p))) - (gone if left >= max(stay, int(len(p) * 0.25)) else set())


def test_wall_strips(spark):
    """A low cupboard goes; a bed in the middle, the foot of a wardrobe, a headboard off the floor and a short box stay."""
    rng = np.random.default_rng(9)
    block = lambda n, lo, hi: rng.uniform(lo, hi, (n, 3))
    room = np.vstack([block(900, (0.05, 1, 0), (0.35, 2.6, 0.5)), block(600, (1.5, 1.5, 0.0), (3, 2.4, 0.5)), block(500, (3.65, 2.9, 0), (3.95, 3.6, 2.0)), block(300, (1, 3.7, 0.3), (2.5, 3.9, 0.5)), block(200, (3, 0.05, 0), (3.4, 0.3, 0.5))])
    full = block(300, (0.05, 0.5, 0), (0.3, 3.5, 0.5))
    clouds = {1: room, 2: full, 3: rng.uniform(0, 4, (800, 3)) * [1, 1, 0.15], 4: room[:40]}
    rows = [(s, k, *map(float, v), "c") for s, p in clouds.items() for k, v in enumerate(p)]
    rooms = [(s, 0.0, 4.0, 0.0, 4.0) for s in clouds]
    odd = [(1, 9000, None, 1.0, 1.0, "c"), (7, 1, 1.0, 1.0, 1.0, "c"), (None, 1, 1.0, 1.0, 1.0, "c")]
    p = spark.createDataFrame(rows + odd + rows[:1], "scan_id long, point_id long, x double, y double, z double, depth string")
    r = spark.createDataFrame(rooms, "scan_id long, lo_x double, hi_x double, lo_y double, hi_y double")
    got = strips.without_wall_strips(p.drop("depth").withColumn("wall", p.x), r)
    kept = {}
    for x in got.collect():
        kept.setdefault(x.scan_id, []).append(x.point_id)
    assert got.columns == ["scan_id", "point_id", "x", "y", "z", "wall"] and kept[7] == [1] and kept[None] == [1] and 9000 in kept[1]
    for s, cloud in clouds.items():
        want = _walk_of_walls(cloud, (0, 0), (4, 4), 0.38, 0.55, 1.0, 0.12, 0.25, 0.08, 60, 20)
        assert set(kept[s]) - {9000} == want
    assert set(kept[1]) - {9000} == set(range(900, len(room))) and len(kept[2]) == len(full) and strips.without_wall_strips(p.limit(0), r).count() == 0
