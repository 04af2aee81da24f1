"""Measured objects on made clouds: sizes, rescue, rejection, rescaling, relations."""

import numpy as np
import pytest

from habitrace.operators import grid, planes, space

POINT = "instance_id long, point_id long, x double, y double, z double"


def _box(rng, n, size, at=(0, 0, 0), turn=0.0):
    a = np.radians(turn)
    p = (rng.random((n, 3)) - [0.5, 0.5, 0]) * size
    return p @ np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1]]) + at


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(12)
    far = lambda n: (rng.random((n, 3)) - 0.5) * 8
    # a sparse sheet over the whole place, and a dense thing some way off it
    sheet = np.stack(np.meshgrid(np.arange(0, 6, 0.2), np.arange(0, 6, 0.2), [0.0, 0.2]), axis=-1).reshape(-1, 3)
    sets = {
        1: _box(rng, 900, [1.6, 0.7, 0.8], (2.0, 1.0, 0.1), 35),
        2: np.vstack([_box(rng, 600, [1.2, 0.6, 0.5], (1.0, 2.0, 0.0), 90), far(60)]),
        3: np.vstack([sheet, _box(rng, 400, [0.5, 0.4, 0.5], (3.0, 3.0, 1.6))]),
        4: np.vstack([sheet, _box(rng, 30, [3.4, 3.4, 0.3], (3.0, 3.0, 1.9))]),
        5: far(300),
        6: _box(rng, 15, [1, 1, 1]),
        7: _box(rng, 400, [1.0, 1.0, 0.0], (1, 1, 0.5)),
        8: _box(rng, 400, [1.0, 0.5, 0.4], (1, 1, 0.5)),
    }
    rows = [(k, i, *map(float, p)) for k, pts in sets.items() for i, p in enumerate(pts)] + [(1, 99990, None, 1.0, 1.0), (1, 99991, float("inf"), 1.0, 1.0)]
    points = spark.createDataFrame(rows, POINT)
    frames = spark.createDataFrame([(k, [0.0, 0.0, 0.0], np.eye(3).ravel().tolist()) for k in sets if k != 8], "instance_id long, origin array<double>, axes array<double>")
    scene = spark.createDataFrame([(k, 0.06 if k != 4 else 0.2) for k in sets], "instance_id long, scene_spacing double")
    objects = space.measured(points, frames, scene).persist()
    return sets, objects, {r.instance_id: r for r in objects.collect()}


def test_reasons(made):
    sets, _, got = made
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: None, 3: None, 4: "no_compact_cluster", 5: "diffuse_cluster", 6: "too_few_points", 7: "degenerate_extent", 8: "room_frame_unavailable"}
    assert all((r.status == "ok") == (r.reason is None) == (r.length is not None) == (r.corners is not None) for r in got.values())
    assert got[1].points == len(sets[1]) and got[6].confidence == "unknown"


def test_sizes_and_axes(made):
    sets, _, got = made
    for k, size, turn in ((1, (1.6, 0.7, 0.8), 35), (2, (1.2, 0.6, 0.5), 90)):
        r = got[k]
        assert (r.length, r.width, r.height) == pytest.approx(size, rel=0.06) and r.area == pytest.approx(r.length * r.width)
        a = np.array(r.object_axes).reshape(3, 3)
        assert abs(a[0] @ [np.cos(np.radians(turn)), np.sin(np.radians(turn)), 0]) > 0.998 and a @ a.T == pytest.approx(np.eye(3), abs=1e-9)
        assert np.linalg.det(a) == pytest.approx(1) and a[0] @ np.array(r.center) >= 0
        corners = np.array(r.corners)
        assert np.ptp(corners @ a.T, axis=0) == pytest.approx([r.length, r.width, r.height])
        assert np.array(r.footprint)[:, 2] == pytest.approx(0) and np.array(r.footprint)[:, :2].mean(0) == pytest.approx(r.center[:2])
        assert (r.confidence, 0.15 < r.stability < 0.25) == ("high", True) or r.stability > 0.2
    assert got[2].cleaned <= 602 and got[2].retained > 0.85


def test_compact_cluster_is_rescued(made):
    _, _, got = made
    r = got[3]
    assert r.clusters >= 2 and r.cleaned <= 400 and (r.length, r.width, r.height) == pytest.approx((0.5, 0.4, 0.5), rel=0.08)


def test_rescaling_as_a_whole(made):
    _, objects, got = made
    for r in space.rescaled(objects, 2.5).collect():
        o = got[r.instance_id]
        if o.status == "ok":
            assert [r[k] for k in space.LENGTHS] == pytest.approx([2.5 * o[k] for k in space.LENGTHS]) and r.area == pytest.approx(6.25 * o.area)
            assert np.array(r.corners) == pytest.approx(2.5 * np.array(o.corners)) and np.array(r.footprint) == pytest.approx(2.5 * np.array(o.footprint)) and r.center == pytest.approx([2.5 * c for c in o.center])
            assert (r.stability, r.object_axes, r.cleaned) == (o.stability, o.object_axes, o.cleaned)
        else:
            assert r.length is None and r.center is None
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="scale"):
            space.rescaled(objects, bad)


def test_relations_are_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        c = rng.random(3) * 5
        rows.append((k % 3, k, c.tolist(), (c + rng.normal(0, 0.4, (4, 3))).tolist() if k % 7 else None))
    rows += [(0, 90, None, None), (5, 91, [0.0, 0.0, 0.0], None), (0, 92, rows[0][2], rows[3][3])]
    frame = spark.createDataFrame(rows, "scan_id long, instance_id long, center array<double>, footprint array<array<double>>")
    got = {(r.instance_id, r.rank): (r.other_id, r.center_distance, r.footprint_gap) for r in space.relations(frame).collect()}
    want = {}
    for s, i, c, f in rows:
        near = sorted((float(np.linalg.norm(np.subtract(c, c2))), j, f2) for s2, j, c2, f2 in rows if c is not None and c2 is not None and s2 == s and j != i)[:2] if c is not None else []
        for rank, (d, j, f2) in enumerate(near, 1):
            gap = min(float(np.linalg.norm(np.subtract(p, q))) for p in f for q in f2) if f and f2 else None
            want[i, rank] = (j, round(d, 4), round(gap, 4) if gap is not None else None)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_every_point_has_a_normal(spark):
    """Planes with isolated points: one row a point, straight up where nothing is near."""
    rng = np.random.default_rng(6)
    wall = np.column_stack([np.full(300, 2.0), rng.random((300, 2)) * [3, 2]])
    floor = np.column_stack([rng.random((300, 2)) * [2, 3], np.zeros(300)])
    alone = np.array([[9.0, 9.0, 9.0], [-7.0, 3.0, 4.0], [5.0, -6.0, 1.0]])
    cloud = np.vstack([wall, floor, alone])
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(cloud)] + [(1, 9999, None, 0.0, 0.0)], "scan_id long, point_id long, x double, y double, z double")
    got = {r.point_id: r for r in planes.normals(df, share=0.3).collect()}
    assert set(got) == set(range(len(cloud))) and max(r.n for r in got.values()) == 30
    spread = np.quantile(np.linalg.norm(cloud - np.median(cloud, axis=0), axis=1), 0.9) * 0.3 + 1e-4
    for i, p in enumerate(cloud):
        d = np.linalg.norm(cloud - p, axis=1)
        near = [j for j in np.argsort(d, kind="stable") if d[j] <= spread][:30]
        n = np.array([got[i].nx, got[i].ny, got[i].nz])
        assert got[i].n == len(near) and np.linalg.norm(n) == pytest.approx(1)
        if len(near) < 3:
            assert n.tolist() == [0, 0, 1]
        else:
            cov = np.cov(cloud[near].T, bias=True)
            assert n @ cov @ n == pytest.approx(np.linalg.eigvalsh(cov)[0], abs=1e-9)
    assert planes.normals(df.limit(0)).count() == 0


def test_only_the_ceiling_goes(spark):
    rng = np.random.default_rng(7)
    plane = lambda n, z: np.column_stack([rng.random((n, 2)) * [4, 3], np.full(n, z) + rng.normal(0, 0.003, n)])
    wall = np.column_stack([rng.normal(0, 0.003, 900), rng.random((900, 2)) * [3, 2.38]])
    alone = np.array([[9.0, 9.0, 2.6], [2.0, 1.5, 1.2]])
    cloud = np.vstack([plane(1500, 0.0), wall, plane(400, 2.4), alone])
    rows = [(1, i, *map(float, p)) for i, p in enumerate(cloud)] + [(2, i, *map(float, p)) for i, p in enumerate(wall)]
    got = planes.without_ceiling(spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double"), trials=200).collect()
    assert len(got) == len(rows)
    gone = {r.point_id for r in got if r.removed and r.scan_id == 1}
    ceiling = set(range(2400, 2800))
    assert gone <= ceiling | {2800} and len(gone) > 0.5 * len(ceiling) * 0.08 / 0.14 and not any(r.removed for r in got if r.scan_id == 2)
    assert {r.ceiling is None for r in got if r.scan_id == 2} == {True}


def test_opening_and_labels(spark):
    """Against brute force on random grids: blocks of four, eight neighbours."""
    rng = np.random.default_rng(3)
    taken = rng.random((40, 40)) < 0.55
    df = spark.createDataFrame([(1, int(r), int(c), float(r), float(c)) for r, c in np.argwhere(taken)], "scan_id long, row long, col long, low double, high double")
    want = np.zeros_like(taken)
    for r in range(39):
        for c in range(39):
            if taken[r : r + 2, c : c + 2].all():
                want[r : r + 2, c : c + 2] = True
    opened = grid.opened(df)
    assert {(r.row, r.col) for r in opened.collect()} == set(map(tuple, np.argwhere(want).tolist()))
    todo, parts = set(map(tuple, np.argwhere(want).tolist())), []
    while todo:
        part, front = set(), [todo.pop()]
        while front:
            r, c = front.pop()
            part.add((r, c))
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & todo
            todo -= near
            front += near
        parts.append(part)
    got = {(r.row0, r.row1, r.col0, r.col1, r.cells) for r in grid.obstacles(df.join(opened, ["scan_id", "row", "col"])).collect()}
    assert got == {(min(r for r, _ in p), max(r for r, _ in p), min(c for _, c in p), max(c for _, c in p), len(p)) for p in parts if len(p) >= 18} and got
    assert grid.opened(df.limit(0)).count() == 0
