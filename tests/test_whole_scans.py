"""Queries over whole scans: all vectors in five, by brute force over the table itself."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from habitrace.operators import spatial, views
from habitrace.plans import registry

SCANS = 5


@pytest.fixture(scope="module")
def clouds(sf_dir):
    """(ids, vectors, labels) of each scan."""
    t = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id")
    t["scan"] = t.vec_id % SCANS
    return {s: (g.vec_id.to_numpy(), np.stack(g.embedding.to_numpy()).astype(float), g.label.to_numpy()) for s, g in t.groupby("scan")}


def _rows(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir).collect()


def _within(v, margins):
    """Points (rows) in boxes (columns) of a scan."""
    c, size, yaw = v[:, :3] * 10, (abs(v[:, 3:6]) + 0.05) * 2, v[:, 6] * 3
    d = c[:, None] - c[None]
    along, across = np.cos(yaw) * d[..., 0] + np.sin(yaw) * d[..., 1], np.cos(yaw) * d[..., 1] - np.sin(yaw) * d[..., 0]
    return np.logical_and.reduce([abs(x) <= size[:, k] / 2 + margins[k] for k, x in enumerate((along, across, d[..., 2]))])


def _distances(v):
    return np.sqrt(sum((v[:, None, k] - v[None, :, k]) ** 2 for k in range(3)))


def test_point_in_box_of_whole_scans(spark, sf_dir, clouds):
    want = {(s, ids[p], ids[b]) for s, (ids, v, _) in clouds.items() for p, b in np.argwhere(_within(v, (0.12, 0.12, 0.08)))}
    assert {(r.scan_id, r.point_id, r.box_id) for r in _rows(spark, sf_dir, "point_in_box")} == want


def test_box_support_of_whole_scans(spark, sf_dir, clouds):
    want = {(i, n) for ids, v, _ in clouds.values() for i, n in zip(ids, _within(v, (0.12, 0.12, 0.08)).sum(axis=0)) if n >= 3}
    assert {(r.box_id, r.support) for r in _rows(spark, sf_dir, "box_support_filter")} == want


def test_radius_neighbors_of_whole_scans(spark, sf_dir, clouds):
    want = {(s, ids[a], ids[b]) for s, (ids, v, _) in clouds.items() for a, b in np.argwhere(_distances(v) <= 0.08) if a != b}
    assert {(r.scan_id, r.a, r.b) for r in _rows(spark, sf_dir, "radius_neighbors")} == want


def test_box_margins_of_whole_scans(spark, sf_dir, clouds):
    margins = {"passage": (0.0, 0.0, 0.0), "opening": (0.08, 0.08, 0.08), "candidate": (0.10, 0.10, 0.10), "instance": (0.12, 0.12, 0.08), "structure": (0.12, 0.12, 0.12), "support": (0.15, 0.15, 0.10)}
    want = {(name, i): n for ids, v, _ in clouds.values() for name, m in margins.items() for i, n in zip(ids, _within(v, m).sum(axis=0)) if n}
    assert {(r.variant, r.box_id): r.n for r in _rows(spark, sf_dir, "box_margins")} == want


def test_radius_outlier_of_whole_scans(spark, sf_dir, clouds):
    want = {(s, i): n > 3 for s, (ids, v, _) in clouds.items() for i, n in zip(ids, (_distances(v) <= 0.12).sum(axis=1))}
    assert {(r.scan_id, r.point_id): r.kept for r in _rows(spark, sf_dir, "radius_outlier")} == want


def test_neighbours_in_full_and_empty_cells(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 0.02, (60, 3)), rng.uniform(-1, 1, (200, 3)), np.tile([[2.0, 2.0, 2.0]], (3, 1)), np.tile([[3.0, 3.0, 3.0]], (4, 1))])
    df = spark.createDataFrame([(k % 2 if k < 260 else 7, k, *map(float, p)) for k, p in enumerate(v)], "scan_id long, point_id long, x double, y double, z double")
    got = {(r.scan_id, r.point_id): r.kept for r in spatial.with_neighbours(df, 0.12, 3).collect()}
    scan = np.array([k % 2 if k < 260 else 7 for k in range(len(v))])
    n = ((_distances(v) <= 0.12) & (scan[:, None] == scan[None])).sum(axis=1) - 1
    assert got == {(s, k): n[k] >= 3 for k, s in enumerate(scan)} and set(got.values()) == {True, False}


def test_knn_stat_outlier_of_whole_scans(spark, sf_dir, clouds):
    want = {}
    for s, (ids, v, _) in clouds.items():
        m = np.sort(_distances(v), axis=1)[:, 1:21].mean(axis=1)
        limit = m.mean() + 1.6 * m.std(ddof=1)
        want |= {(s, i): (pytest.approx(d, abs=1e-6), d > limit) for i, d in zip(ids, m)}
    assert {(r.scan_id, r.point_id): (r.mean_d, r.outlier) for r in _rows(spark, sf_dir, "knn_stat_outlier")} == want


def test_nn_gap_of_whole_scans(spark, sf_dir, clouds):
    want = {}
    for s, (_, v, labels) in clouds.items():
        d = _distances(v)
        want |= {(s, a, b): pytest.approx(d[np.ix_(labels == a, labels == b)].min(), abs=1e-6) for a in set(labels) for b in set(labels) if a < b}
    assert {(r.scan_id, r.la, r.lb): r.gap for r in _rows(spark, sf_dir, "nn_gap")} == want


def _to_edges(p, q):
    """Least distance of the corners of each rectangle (n, 4, 2) to the edges of its partner."""
    best = np.full(len(p), np.inf)
    for j in range(4):
        a, e = q[:, None, j], q[:, None, (j + 1) % 4] - q[:, None, j]
        t = np.clip(((p - a) * e).sum(-1) / (e * e).sum(-1), 0, 1)
        best = np.minimum(best, np.linalg.norm(p - a - t[..., None] * e, axis=-1).min(axis=1))
    return best


def _pairs(v):
    """(a, b, corners of a, corners of b, apart) of all pairs of boxes of a scan."""
    c, size, yaw = v[:, :2] * 10, (abs(v[:, 3:5]) + 0.05) * 2, v[:, 6] * 3
    u, w = np.stack([np.cos(yaw), np.sin(yaw)], -1), np.stack([-np.sin(yaw), np.cos(yaw)], -1)
    ring = np.stack([c + u * size[:, :1] / 2 * i + w * size[:, 1:] / 2 * j for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))], 1)
    a, b = np.triu_indices(len(v), 1)
    apart = np.zeros(len(a), bool)
    for axis in (u[a], w[a], u[b], w[b]):
        m, n = (ring[a] * axis[:, None]).sum(-1), (ring[b] * axis[:, None]).sum(-1)
        apart |= (m.max(1) < n.min(1)) | (n.max(1) < m.min(1))
    return a, b, ring[a], ring[b], apart


def test_rectangle_clearance_of_whole_scans(spark, sf_dir, clouds):
    want = {}
    for s, (ids, v, _) in clouds.items():
        a, b, p, q, apart = _pairs(v)
        d = np.where(apart, np.minimum(_to_edges(p, q), _to_edges(q, p)), 0.0)
        want |= {(s, ids[i], ids[j]): pytest.approx(k, abs=1e-6) for i, j, k in zip(a, b, d) if k <= 0.3}
    assert {(r.scan_id, r.a, r.b): r.clearance for r in _rows(spark, sf_dir, "rectangle_clearance")} == want


def test_legacy_clearance_of_whole_scans(spark, sf_dir, clouds):
    want = {}
    for ids, v, _ in clouds.values():
        a, b, p, q, _ = _pairs(v)
        low, high = np.maximum(p.min(1), q.min(1)), np.minimum(p.max(1), q.max(1))
        near, least = ((low - high) <= 0.3).all(axis=1), np.full(len(a), np.inf)
        for ring in (p, q):
            order = ring[:, [0, 3, 1, 2]]
            for i in range(4):
                e = order[:, (i + 1) % 4] - order[:, i]
                axis = np.stack([-e[:, 1], e[:, 0]], -1) / np.linalg.norm(e, axis=1)[:, None]
                m, n = ((k * axis[:, None]).sum(-1) for k in (p, q))
                gap = np.maximum(m.min(1), n.min(1)) - np.minimum(m.max(1), n.max(1))
                least = np.where(gap > 1e-9, np.minimum(least, gap), least)
        want |= {(ids[i], ids[j]): pytest.approx(g, abs=1e-6) for i, j, g in zip(a[near], b[near], np.where(least < np.inf, least, 0.0)[near])}
    assert {(r.a, r.b): r.gap for r in _rows(spark, sf_dir, "legacy_clearance")} == want


def test_points_in_openings_of_whole_scans(spark, sf_dir, clouds):
    want = set()
    for s, (ids, v, labels) in clouds.items():
        c, size = v[:, :3] * 10 + (0, 0, 1), (abs(v[:, 3:6]) + 0.05) * 2 * (2, 2, 3)
        for k in np.flatnonzero(labels < 2):
            axis = 1 if ids[k] % 4 in (1, 3) else 0
            hit = (abs(c[:, axis] - c[k, axis]) <= size[k, 0] / 2 + 0.08) & (abs(c[:, 2] - c[k, 2]) <= size[k, 2] / 2 + 0.08)
            want |= {(s, i, ids[k]) for i in ids[hit]}
    assert {(r.scan_id, r.point_id, r.opening_id) for r in _rows(spark, sf_dir, "points_in_openings")} == want


def test_view_diversity_of_whole_scans(spark, sf_dir, clouds):
    want = {}
    for s, (_, v, _) in clouds.items():
        rays = v[:, :3] / np.linalg.norm(v[:, :3], axis=1)[:, None]
        want[s] = (pytest.approx(np.arccos(np.clip(rays @ rays.T, -1, 1)).max(), abs=2e-6), pytest.approx(_distances(v).max(), abs=1e-6))
    assert {r.scan_id: (r.widest, r.baseline) for r in _rows(spark, sf_dir, "view_diversity")} == want


def test_diversity_of_narrow_and_wide_views(spark):
    rng = np.random.default_rng(4)
    narrow, wide = rng.normal(0, 0.2, (200, 3)) + (3, 0, 0), rng.normal(0, 1, (200, 3))
    df = spark.createDataFrame([(s, *map(float, p)) for s, v in enumerate((narrow, wide)) for p in v], "scan_id long, x double, y double, z double")
    got = {r.scan_id: r for r in views.diversity(df, F.lit(0.8)).collect()}
    for s, v in enumerate((narrow, wide)):
        rays = v / np.linalg.norm(v, axis=1)[:, None]
        assert got[s].widest == pytest.approx(np.arccos(np.clip(rays @ rays.T, -1, 1)).max(), abs=1e-6) and got[s].baseline == pytest.approx(_distances(v).max())
