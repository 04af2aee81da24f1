"""Density clusters from cells against all pairs."""

import numpy as np
import pandas as pd
import pytest

from habitrace.operators import density
from habitrace.plans import registry


def _walk(ids, v, eps, least):
    """{id: (core, cluster)} by all distances."""
    near = np.sqrt(sum((v[:, None, k] - v[None, :, k]) ** 2 for k in range(3))) <= eps
    core = near.sum(axis=1) >= least
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(axis=1), label)
        if (new == label).all():
            break
        label = new
    beside = np.where(near & core[None], label[None], np.iinfo(np.int64).max).min(axis=1)
    return {int(i): (bool(c), int(b) if b < np.iinfo(np.int64).max else None) for i, c, b in zip(ids, core, beside)}


def test_clusters_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(21)
    lattice = np.stack(np.meshgrid(*[np.arange(4) * 0.25] * 3), axis=-1).reshape(-1, 3)  # neighbours at the radius itself
    chain = np.stack([np.arange(0, 6, 0.02), np.sin(np.arange(0, 6, 0.02)), np.zeros(300)], axis=-1)
    sets = {
        0: (np.concatenate([rng.normal(0, 0.1, (700, 3)), rng.uniform(-1, 1, (300, 3)), np.tile([[0.9, 0.9, 0.9]], (9, 1)), np.tile([[-0.9, 0.9, 0.9]], (7, 1))]), 0.08),
        1: (lattice - 5.0, 0.25),
        2: (np.concatenate([chain, rng.normal((3, 3, 0), 0.15, (250, 3)), rng.normal((3.55, 3, 0), 0.15, (250, 3))]), 0.06),
        3: (rng.uniform(0, 9, (40, 3)), 0.1),
    }
    rows, want, at = [], {}, 0
    for s, (v, eps) in sets.items():
        ids = rng.permutation(len(v)) + at
        at += len(v)
        rows += [(s, int(i), *map(float, p)) for i, p in zip(ids, v)]
        want |= {(s, i): r for i, r in _walk(ids, v, eps, 8 if s != 1 else 6).items()}
    odd = [(0, at, float("nan"), 0.0, 0.0), (0, at + 1, None, 0.0, 0.0), (None, at + 2, 0.0, 0.0, 0.0), (9, at + 3, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows + odd, "scan_id long, point_id long, x double, y double, z double")
    radius = spark.createDataFrame([(s, eps) for s, (_, eps) in sets.items()], "scan_id long, eps double")
    got = {}
    for least, kept in ((8, "scan_id is null or scan_id <> 1"), (6, "scan_id = 1")):
        q = p.filter(kept)
        got |= {(r.scan_id, r.point_id): (r.core, r.cluster) for r in density.clusters(q, density.places(q), radius, least).collect()}
    assert got == want | {(s, i): (False, None) for s, i, *_ in odd}
    assert {c for c, _ in want.values()} == {True, False} and any(not c and k is not None for c, k in want.values())


def test_gaps_of_copies_and_lonely_points(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 0.0), (0, 3, 0.1, 0.0, 0.0), (0, 4, 5.0, 0.0, 0.0), (1, 5, 0.0, 0.0, 0.0), (1, 6, 0.0, 0.5, 0.0)]
    held = density.places(spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double"))
    assert sorted(map(tuple, density.neighbour_gaps(held, 0.18).collect())) == [(0, 0.0, 2), (0, 0.1, 1)]


@pytest.mark.parametrize("copies", [0, 400])
def test_adaptive_dbscan_as_before(spark, tmp_path, copies):
    """The clusters are those of the pairs within the radius, also with many vectors in one place; no pairs are made."""
    rng = np.random.default_rng(22)
    v = np.concatenate([rng.normal(0, 0.12, (900, 3)), np.tile(rng.normal(0, 0.12, (1, 3)), (copies, 1))]).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v), "label": rng.integers(0, 3, len(v))}).to_parquet(f"{tmp_path}/embeddings.parquet")
    t = pd.read_parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for label, g in t.groupby("label"):
        w = np.stack(g.embedding.to_numpy()).astype(float)
        d = np.sqrt(sum((w[:, None, k] - w[None, :, k]) ** 2 for k in range(3)))
        np.fill_diagonal(d, np.inf)
        gap = d.min(axis=1)
        want |= {(label, i): r for i, r in _walk(g.vec_id.to_numpy(), w, min(max(4 * np.median(gap[gap <= 0.18]), 0.06), 0.18), 8).items()}
    plan = registry.queries()["adaptive_dbscan"](spark, str(tmp_path))
    assert {(r.scan_id, r.point_id): (r.core, r.cluster) for r in plan.collect()} == want
