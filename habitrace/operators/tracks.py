"""Observations to tracks, fragments to instances: evidence by joins, order-dependent choices on edges only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.operators import graph, spatial
from habitrace.session import settled


def pair_evidence(observations: DataFrame, bridge: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, shared, overlap, frame_gap, conflict, accepted, score) for pairs that share points or a view.

    ``observations`` (keys, obs_id, frame_id, frame_order), ``bridge`` (keys,
    obs_id, point_id). Two masks of one view that share next to nothing are
    different things: a conflict. Two views' masks belong together when they
    share three points and 3 % of the smaller one.
    """
    sizes = bridge.distinct().groupBy(*keys, "obs_id").agg(F.count("*").alias("n"))
    o = observations.join(sizes, [*keys, "obs_id"], "left").fillna(0, ["n"])
    members = o.groupBy(*keys).agg(F.count("*").alias("members"))
    l = bridge.distinct().select(*keys, "point_id", F.col("obs_id").alias("a"))
    r = bridge.distinct().select(*keys, "point_id", F.col("obs_id").alias("b"))
    shared = l.join(r, [*keys, "point_id"]).filter("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))
    view = observations.select(*keys, "frame_id", F.col("obs_id").alias("a")).join(observations.select(*keys, "frame_id", F.col("obs_id").alias("b")), [*keys, "frame_id"]).filter("a < b").select(*keys, "a", "b", F.lit(0).cast("long").alias("shared"))
    pairs = shared.union(view).groupBy(*keys, "a", "b").agg(F.max("shared").alias("shared"))
    side = lambda s: o.select(*keys, F.col("obs_id").alias(s), F.col("frame_id").alias(f"f{s}"), F.col("frame_order").alias(f"t{s}"), F.col("n").alias(f"n{s}"))
    j = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"]).join(members, keys)
    overlap = F.col("shared") / F.greatest(F.least("na", "nb"), F.lit(1))
    j = j.withColumns({"overlap": overlap, "frame_gap": F.abs(F.col("ta") - F.col("tb")), "same": F.col("fa") == F.col("fb")})
    continuity = F.greatest(F.lit(3.0), F.ceil(0.15 * F.col("members")).cast("double"))
    score = 0.55 * F.least(F.col("overlap") / 0.25, F.lit(1.0)) + 0.20 * F.greatest(F.lit(0.0), 1 - F.col("frame_gap") / continuity)
    accepted = ~F.col("same") & (F.col("shared") >= 3) & (F.col("overlap") >= 0.03)
    return j.select(*keys, "a", "b", "shared", "overlap", "frame_gap", (F.col("same") & (F.col("overlap") < 0.02)).alias("conflict"), accepted.alias("accepted"), score.alias("score"))


def merge_with_veto(nodes: list, edges: list[tuple], conflicts: set[frozenset]) -> dict:
    """node -> root: edges in order are joined unless two members of the parts conflict."""
    root, members = {n: n for n in nodes}, {n: [n] for n in nodes}
    for a, b in edges:
        ra, rb = root[a], root[b]
        if ra == rb or any(frozenset((x, y)) in conflicts for x in members[ra] for y in members[rb]):
            continue
        for n in members.pop(rb):
            root[n] = ra
            members[ra].append(n)
    return root


def associate(observations: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, obs_id, track): greedy association by score with a veto, numbered by first frame.

    A group is one kind of thing in one scan; only its observations and edges
    (no points) meet in one task, as the order of joining matters.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in observations.select(*keys, "obs_id").dtypes)

    def one(key: tuple, seen: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        seen = seen.sort_values("obs_id")
        ok = pairs[pairs.accepted].sort_values(["score", "a", "b"], ascending=[False, True, True]) if len(pairs) else pairs
        vetoes = {frozenset(p) for p in zip(pairs.a[pairs.conflict], pairs.b[pairs.conflict])} if len(pairs) else set()
        root = merge_with_veto(seen.obs_id.tolist(), list(zip(ok.a, ok.b)) if len(ok) else [], vetoes)
        first = seen.assign(root=seen.obs_id.map(root)).groupby("root").agg(t=("frame_order", "min"), o=("obs_id", "min")).sort_values(["t", "o"])
        number = {r: k for k, r in enumerate(first.index, 1)}
        return pd.DataFrame({**{k: v for k, v in zip(keys, key)}, "obs_id": seen.obs_id, "track": [number[root[o]] for o in seen.obs_id]})

    both = settled(observations.select(*keys, "obs_id", "frame_order")).groupBy(*keys).cogroup(settled(evidence.select(*keys, "a", "b", "score", "accepted", "conflict")).groupBy(*keys))
    return both.applyInPandas(one, f"{kinds}, track long")


def _merged(fragments: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, fragment, merged): fragments by the least one they are joined with."""
    nodes = fragments.select(F.col("scan_id").alias("scope"), F.col("fragment").alias("node")).distinct()
    found = graph.components(nodes, edges.select(F.col("scan_id").alias("scope"), "a", "b"))
    return found.select(F.col("scope").alias("scan_id"), F.col("node").alias("fragment"), F.col("component").alias("merged"))


def memberships(fragments: DataFrame, masks: DataFrame) -> DataFrame:
    """(scan_id, fragment, mask, hits, size): how many of a fragment's points each mask covers."""
    size = fragments.groupBy("scan_id", "fragment").agg(F.count("*").alias("size"))
    hits = fragments.join(masks, ["scan_id", "point_id"]).groupBy("scan_id", "fragment", "mask").agg(F.count("*").alias("hits"))
    return hits.join(size, ["scan_id", "fragment"])


def merge_by_masks(fragments: DataFrame, masks: DataFrame, eps: float, least: int = 3) -> DataFrame:
    """Fragments that two masks or more cover and that are near: within max(0.12, 2.5 eps).

    ``fragments`` (scan_id, fragment, point_id, x, y, z), ``masks`` (scan_id, mask, point_id).
    """
    on = memberships(fragments, masks).filter(F.col("hits") >= least).select("scan_id", "mask", "fragment")
    pairs = on.alias("l").join(on.alias("r"), ["scan_id", "mask"]).filter("l.fragment < r.fragment").groupBy("scan_id", F.col("l.fragment").alias("a"), F.col("r.fragment").alias("b")).agg(F.count("*").alias("shared")).filter("shared >= 2")
    reach = max(0.12, 2.5 * eps)
    near = spatial.radius_pairs(fragments, reach, keep=("fragment",)).withColumnRenamed("fragment", "fa")
    other = fragments.select("scan_id", F.col("point_id").alias("b"), F.col("fragment").alias("fb"))
    gaps = near.join(other, ["scan_id", "b"]).filter("fa < fb").select("scan_id", F.col("fa").alias("a"), F.col("fb").alias("b")).distinct()
    return _merged(fragments, pairs.join(gaps, ["scan_id", "a", "b"], "left_semi"))


def merge_by_same_mask(fragments: DataFrame, masks: DataFrame, ratio: float = 0.25, least: int = 4) -> DataFrame:
    """Fragments that one mask covers to ``ratio`` and by ``least`` points each."""
    on = memberships(fragments, masks).filter(F.col("hits") >= F.greatest(F.lit(least), F.floor(ratio * F.col("size"))))
    first = on.groupBy("scan_id", "mask").agg(F.min("fragment").alias("a"))
    edges = on.join(first, ["scan_id", "mask"]).filter("fragment > a").select("scan_id", "a", F.col("fragment").alias("b")).distinct()
    return _merged(fragments, edges)


def merge_tracks(fragments: DataFrame, masks: DataFrame, groups: DataFrame, canonical: str, eps: float, least: int = 3) -> DataFrame:
    """(scan_id, fragment, merged): fragments joined by repeated mask support, with a semantic veto.

    ``masks`` also has ``view``. Two views that cover both fragments join them
    at any distance, one view only when they are near. ``groups`` (scan_id,
    fragment, grp) tells the dominant spatial candidate: parts of the
    ``canonical`` group are never joined with parts of another. The order of
    joining is by fragment number, so edges of one scan meet in one task.
    """
    on = memberships(fragments, masks.select("scan_id", "mask", "point_id")).filter(F.col("hits") >= least).select("scan_id", "mask", "fragment").join(masks.select("scan_id", "mask", "view").distinct(), ["scan_id", "mask"])
    pairs = on.alias("l").join(on.alias("r"), ["scan_id", "mask", "view"]).filter("l.fragment < r.fragment").groupBy("scan_id", F.col("l.fragment").alias("a"), F.col("r.fragment").alias("b")).agg(F.countDistinct("view").alias("views"))
    near = spatial.radius_pairs(fragments, max(0.12, 2.5 * eps), keep=("fragment",)).withColumnRenamed("fragment", "fa")
    other = fragments.select("scan_id", F.col("point_id").alias("b"), F.col("fragment").alias("fb"))
    close = near.join(other, ["scan_id", "b"]).filter("fa < fb").select("scan_id", F.col("fa").alias("a"), F.col("fb").alias("b"), F.lit(True).alias("near")).distinct()
    edges = pairs.join(close, ["scan_id", "a", "b"], "left").filter("views >= 2 or near").select("scan_id", "a", "b")
    nodes = fragments.select("scan_id", "fragment").distinct().join(groups, ["scan_id", "fragment"], "left")

    def one(key: tuple, parts: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        of = {f: {g} if isinstance(g, str) else set() for f, g in zip(parts.fragment, parts.grp)}
        root, held = {f: f for f in of}, {f: set(g) for f, g in of.items()}
        for a, b in sorted(zip(links.a, links.b)) if len(links) else []:
            ra, rb = root[a], root[b]
            both = held[ra] | held[rb]
            if ra == rb or (canonical in both and len(both) > 1):
                continue
            held[ra] = both
            root = {f: ra if r == rb else r for f, r in root.items()}
        least_of: dict = {}
        for f, r in root.items():
            least_of[r] = min(f, least_of.get(r, f))
        return pd.DataFrame({"scan_id": key[0], "fragment": list(root), "merged": [least_of[r] for r in root.values()]})

    return settled(nodes).groupBy("scan_id").cogroup(settled(edges).groupBy("scan_id")).applyInPandas(one, "scan_id long, fragment long, merged long")


def complete_link(xy: np.ndarray, threshold: float) -> np.ndarray:
    """Clusters whose members are all within ``threshold``: the nearest pair of clusters (by their farthest members) is joined first."""
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    np.fill_diagonal(d, np.inf)
    label = np.arange(len(xy))
    while len(xy) > 1:
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        if d[i, j] > threshold:
            break
        i, j = min(i, j), max(i, j)
        label[label == j] = i
        d[i], d[:, i] = np.maximum(d[i], d[j]), np.maximum(d[:, i], d[:, j])
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
    return label


def link_clusters(rows: DataFrame, keys: list[str], threshold: float = 0.48) -> DataFrame:
    """(keys, row_id, cluster): complete-link clusters of a group's places, named by their least row.

    ``rows`` (keys, row_id, x, y): the detections of one kind in one room.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*keys, "row_id").dtypes)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_id")
        label = complete_link(group[["x", "y"]].to_numpy(float), threshold)
        return pd.DataFrame({**{k: v for k, v in zip(keys, key)}, "row_id": group.row_id, "cluster": group.row_id.to_numpy()[label]})

    return rows.select(*keys, "row_id", "x", "y").groupBy(*keys).applyInPandas(one, f"{kinds}, cluster long")


def dense_components(points: DataFrame, quantile: float = 0.25, factor: float = 3.0, reach: float = 0.1) -> DataFrame:
    """(scan_id, point_id, component, size): components by a radius of ``factor`` low quantiles of the 4th neighbour's distance."""
    fourth = spatial.nearest(points, points, 4, reach).groupBy("scan_id", F.col("a").alias("point_id")).agg(F.max("d").alias("d"))
    radius = fourth.groupBy("scan_id").agg(F.greatest(F.percentile("d", quantile) * factor, F.lit(1e-5)).alias("radius"))
    widest = radius.agg(F.max("radius")).first()[0] or reach
    pairs = spatial.radius_pairs(points, widest).join(radius, "scan_id").filter("d <= radius")
    found = graph.components(points.select(F.col("scan_id").alias("scope"), F.col("point_id").alias("node")), pairs.select(F.col("scan_id").alias("scope"), "a", "b"))
    size = found.groupBy("scope", "component").agg(F.count("*").alias("size"))
    return found.join(size, ["scope", "component"]).select(F.col("scope").alias("scan_id"), F.col("node").alias("point_id"), "component", "size")


def largest(clusters: DataFrame) -> DataFrame:
    """(scan_id, cluster, n): the largest cluster of each scan, the least id among equals; noise (NULL) is none."""
    n = clusters.filter("cluster is not null").groupBy("scan_id", "cluster").agg(F.count("*").alias("n"))
    return n.groupBy("scan_id").agg(F.max_by(F.struct("cluster", "n"), F.struct("n", -F.col("cluster"))).alias("b")).select("scan_id", "b.cluster", "b.n")


def exclude_footprints(points: DataFrame, objects: DataFrame, margin: float = 0.10, least: int = 50) -> DataFrame:
    """(scan_id, object_id, point_id): points of each object outside the footprints of earlier objects, in their order.

    ``points`` (scan_id, object_id, point_id, x, y), ``objects`` (scan_id,
    object_id, rank, cx, cy, sx, sy, yaw). An earlier footprint only cuts while
    more than ``least`` points stay. Points are reduced to which footprints
    they lie in; the sequence runs over the few different answers of an object.
    """
    own = objects.select("scan_id", "object_id", F.col("rank").alias("own_rank"))
    earlier = own.join(objects.withColumnRenamed("object_id", "other"), "scan_id").filter("rank < own_rank")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    c, s = F.cos("yaw"), F.sin("yaw")
    inside = (F.abs(c * dx + s * dy) <= F.col("sx") / 2 + margin) & (F.abs(c * dy - s * dx) <= F.col("sy") / 2 + margin)
    hit = points.join(earlier, ["scan_id", "object_id"]).filter(inside).groupBy("scan_id", "object_id", "point_id").agg(F.array_sort(F.collect_set("rank")).alias("in_ranks"))
    marked = points.select("scan_id", "object_id", "point_id").join(hit, ["scan_id", "object_id", "point_id"], "left").withColumn("in_ranks", F.coalesce("in_ranks", F.array().cast("array<bigint>")))
    counts = marked.groupBy("scan_id", "object_id", "in_ranks").agg(F.count("*").alias("n"))

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        alive, applied = [(set(r), n) for r, n in zip(group.in_ranks, group.n)], []
        for rank in sorted(set().union(*(r for r, _ in alive))):
            rest = [(r, n) for r, n in alive if rank not in r]
            if sum(n for _, n in rest) > least:
                alive, applied = rest, [*applied, int(rank)]
        return pd.DataFrame({"scan_id": [key[0]], "object_id": [key[1]], "applied": [applied]})

    chosen = counts.groupBy("scan_id", "object_id").applyInPandas(one, "scan_id long, object_id long, applied array<bigint>")
    return marked.join(chosen, ["scan_id", "object_id"]).filter(~F.arrays_overlap("in_ranks", "applied")).select("scan_id", "object_id", "point_id")
