"""What speaks for two observations being one thing, with the gap between their points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.operators import spatial
from habitrace.session import settled

#: Range of the adjacency limit and its share of both extents, shares of points, least shared points, least frames and share of a group's observations between two views.
NEAREST, FARTHEST, OF_SIZE, APART, OVERLAP, SHARED, FRAMES, OF_GROUP = 0.08, 0.30, 0.18, 0.02, 0.03, 3, 3, 0.15


def evidence(observations: DataFrame, bridge: DataFrame, points: DataFrame, keys: list[str], point_keys: list[str]) -> DataFrame:
    """(keys, a, b, shared, overlap, iou, gap, distance, frame_gap, conflict, accepted, reason, score), a < b.

    ``observations`` (keys, obs_id, frame_id, frame_order), ``bridge`` (keys,
    obs_id, point_id), ``points`` (point_keys, point_id, x, y, z), where
    ``point_keys`` are among ``keys``. Rows are the pairs that share points or
    a view, or whose points come within 0.30 of each other, which is the widest
    adjacency limit; no others are ever accepted or in conflict. ``gap`` is the
    least distance of their points, 0 where they share one, null beyond 0.30.
    Two masks of one view apart from each other are a conflict. Two views'
    masks belong together when they share three points and 3 % of the smaller
    one, or are adjacent, close in time and close in space. Points without a
    place count as shared ids only; observations without points meet others of
    their view only. Repeated rows count once.
    """
    seen = observations.select(*keys, "obs_id", "frame_id", "frame_order").dropDuplicates([*keys, "obs_id"])
    own = settled(bridge.select(*keys, "obs_id", "point_id").distinct().join(seen.select(*keys, "obs_id"), [*keys, "obs_id"], "left_semi"))
    placed = settled(own.join(points.dropna(subset=list("xyz")).select(*point_keys, "point_id", *"xyz").dropDuplicates([*point_keys, "point_id"]), [*point_keys, "point_id"]))
    spread = {c: F.percentile(c, F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))) for c in "xyz"}
    shape = placed.groupBy(*keys, "obs_id").agg(*(v.alias(c) for c, v in spread.items()))
    size = shape.select(*keys, "obs_id", F.sqrt(sum(((F.col(c)[2] - F.col(c)[0]) ** 2 for c in "yz"), (F.col("x")[2] - F.col("x")[0]) ** 2)).alias("scale"), *(F.col(c)[1].alias(f"m{c}") for c in "xyz"))
    n = own.groupBy(*keys, "obs_id").agg(F.count("*").alias("n"))
    told = settled(seen.join(n, [*keys, "obs_id"], "left").join(size, [*keys, "obs_id"], "left").fillna(0, ["n"]).fillna(0.0, ["scale", "mx", "my", "mz"]))

    side = lambda rows, name, *more: rows.select(*keys, F.col("obs_id").alias(name), *more)
    shared = settled(side(own, "a", "point_id").join(side(own, "b", "point_id"), [*keys, "point_id"]).filter("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("shared")))
    views = side(seen, "a", "frame_id").join(side(seen, "b", "frame_id"), [*keys, "frame_id"]).filter("a < b").select(*keys, "a", "b")
    celled = placed.select(*keys, "obs_id", *"xyz", *(spatial.cell(c, FARTHEST).alias(f"g{c}") for c in "xyz"))
    around = celled
    for c in "xyz":
        around = around.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + j for j in (-1, 0, 1)))))
    left = side(around, "a", *(F.col(c).alias(f"a{c}") for c in "xyz"), "gx", "gy", "gz")
    d2 = sum(((F.col(f"a{c}") - F.col(c)) ** 2 for c in "yz"), (F.col("ax") - F.col("x")) ** 2)
    met = left.join(side(celled, "b", *"xyz", "gx", "gy", "gz"), [*keys, "gx", "gy", "gz"]).filter("a < b")
    near = settled(met.groupBy(*keys, "a", "b").agg(F.sqrt(F.min(d2)).alias("near")).filter(F.col("near") <= FARTHEST))

    pairs = shared.select(*keys, "a", "b").union(views).union(near.select(*keys, "a", "b")).distinct()
    both = [*keys, "a", "b"]
    j = settled(pairs).join(shared, both, "left").join(near, both, "left").fillna(0, ["shared"])
    for s in "ab":
        j = j.join(told.select(*keys, F.col("obs_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("frame_id", "frame_order", "n", "scale", "mx", "my", "mz"))), [*keys, s])
    j = j.join(told.groupBy(*keys).agg(F.count("*").alias("members")), keys)
    of = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    sizes = F.col("scale_a") + F.col("scale_b")
    j = j.withColumns({
        "overlap": F.col("shared") / F.greatest(F.least(*of("n")), F.lit(1)), "iou": F.col("shared") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("shared"), F.lit(1)), "gap": F.when(F.col("shared") > 0, 0.0).otherwise(F.col("near")),
        "distance": F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in ("my", "mz")), (F.col("mx_a") - F.col("mx_b")) ** 2)), "frame_gap": F.abs(F.col("frame_order_a") - F.col("frame_order_b")),
        "continuity": F.greatest(F.lit(float(FRAMES)), F.ceil(OF_GROUP * F.col("members")).cast("double")), "limit": F.greatest(F.lit(NEAREST), F.least(F.lit(FARTHEST), OF_SIZE * sizes)), "same": F.col("frame_id_a") == F.col("frame_id_b"),
    })
    adjacent = F.coalesce(F.col("gap") <= F.col("limit"), F.lit(False))
    conflict = F.col("same") & (F.col("overlap") < APART) & ~adjacent
    strong = (F.col("shared") >= SHARED) & (F.col("overlap") >= OVERLAP)
    close = ~F.col("same") & (F.col("frame_gap") <= F.col("continuity")) & adjacent & (F.col("distance") <= sizes + F.col("limit"))
    reason = F.when(conflict, "same_view_separate_masks").when(F.col("same"), "same_view_masks_are_not_cross_view_evidence").when(strong, "shared_projected_3d_points").when(close, "spatially_adjacent_with_view_continuity").when(F.col("frame_gap") > F.col("continuity"), "no_overlap_and_view_gap_too_large").otherwise("insufficient_cross_view_relation")
    beside = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("gap") / F.col("limit")), F.lit(0.0))
    score = 0.55 * F.least(F.col("overlap") / 0.25, F.lit(1.0)) + 0.25 * beside + 0.20 * F.greatest(F.lit(0.0), 1 - F.col("frame_gap") / F.col("continuity"))
    return j.select(*both, "shared", "overlap", "iou", "gap", "distance", "frame_gap", conflict.alias("conflict"), (~F.col("same") & (strong | close)).alias("accepted"), reason.alias("reason"), F.least(score, F.lit(1.0)).alias("score"))
