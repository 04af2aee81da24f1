"""Evidence for pairs against a walk over all pairs."""

import math

import numpy as np
import pytest

from habitrace.operators import pairs


def _walk(obs, ids, place):
    out = {}
    for a in sorted(obs):
        for b in sorted(obs):
            if a >= b or obs[a][0] != obs[b][0]:
                continue
            (_, fa, ta), (_, fb, tb) = obs[a], obs[b]
            pa, pb = (np.array([place[i] for i in sorted(ids[k]) if i in place]).reshape(-1, 3) for k in (a, b))
            shared = len(ids[a] & ids[b])
            overlap = shared / max(min(len(ids[a]), len(ids[b])), 1)
            gap = 0.0 if shared else min((math.dist(x, y) for x in pa for y in pb), default=math.inf)
            scale = [float(np.linalg.norm(np.percentile(p, 98, axis=0) - np.percentile(p, 2, axis=0))) if len(p) else 0.0 for p in (pa, pb)]
            centre = [np.median(p, axis=0) if len(p) else np.zeros(3) for p in (pa, pb)]
            apart, limit, steps = math.dist(*centre), max(0.08, min(0.3, 0.18 * sum(scale))), max(3, math.ceil(0.15 * sum(o[0] == obs[a][0] for o in obs.values())))
            conflict = fa == fb and overlap < 0.02 and gap > limit
            strong, near = shared >= 3 and overlap >= 0.03, fa != fb and abs(ta - tb) <= steps and gap <= limit and apart <= sum(scale) + limit
            score = 0.55 * min(overlap / 0.25, 1) + 0.25 * max(0, 1 - gap / limit) + 0.2 * max(0, 1 - abs(ta - tb) / steps)
            out[a, b] = (shared, gap, conflict, fa != fb and (strong or near), min(score, 1), fa == fb)
    return out


def test_evidence(spark):
    rng = np.random.default_rng(12)
    centre = rng.uniform(0, 2.2, (9, 3)) * [1, 1, 0.3]
    cloud = [(1, k, *map(float, centre[k % 9] + rng.normal(0, 0.07, 3))) for k in range(360)] + [(1, 900, None, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    place = {r[1]: r[2:] for r in cloud if r[0] == 1 and r[2] is not None}
    obs, ids = {}, {}
    for k in range(40):
        obs[k] = ("chair" if k % 3 else "bed", k // 5, k // 5)
        ids[k] = {int(i) for i in rng.choice(range(k % 9, 360, 9), int(rng.integers(2, 12)), replace=False)}
    obs[40], ids[40] = ("bed", 0, 0), set()
    obs[41], ids[41] = ("bed", 7, 7), {900}
    obs[42], ids[42] = ("bed", 6, 6), {900, 777}
    o = spark.createDataFrame([(1, g, k, f, t) for k, (g, f, t) in obs.items()] + [(1, "bed", 0, 0, 0)], "scan_id long, grp string, obs_id long, frame_id long, frame_order long")
    b = spark.createDataFrame([(1, obs[k][0], k, i) for k, each in ids.items() for i in each] * 2 + [(1, "bed", 999, 5)], "scan_id long, grp string, obs_id long, point_id long")
    p = spark.createDataFrame(cloud + cloud[:3], "scan_id long, point_id long, x double, y double, z double")
    got = {(r.a, r.b): r for r in pairs.evidence(o, b, p, ["scan_id", "grp"], ["scan_id"]).collect()}
    want = _walk(obs, ids, place)
    assert set(got) == {k for k, (shared, gap, *_, same) in want.items() if shared or gap <= 0.3 or same}
    assert not any(w[2] or w[3] for k, w in want.items() if k not in got)
    for k, r in got.items():
        shared, gap, conflict, accepted, score, _ = want[k]
        assert (r.shared, r.conflict, r.accepted) == (shared, conflict, accepted) and r.score == pytest.approx(score), (k, r, want[k])
        assert r.gap is None and gap > 0.3 or r.gap == pytest.approx(gap)
    assert len({r.reason for r in got.values()}) >= 5 and any(r.conflict for r in got.values())
    assert pairs.evidence(o.limit(0), b, p, ["scan_id", "grp"], ["scan_id"]).count() == 0
    assert pairs.evidence(o, b.limit(0), p, ["scan_id", "grp"], ["scan_id"]).filter("accepted").count() == 0
