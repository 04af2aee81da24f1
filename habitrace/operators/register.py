"""Registration of frames to a base cloud by iterated closest points.

All frames move at once: a round meets each moved point with the base points in
the cells around it, keeps the nearest, and adds up moments for each frame; only
one 3 x 3 matrix a frame reaches Python. Frames that stand still leave the loop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.operators import spatial
from habitrace.session import settled

#: Gates of the reference: share of points with a partner before and after, root mean square distance, points.
OVERLAP, FITNESS, RMSE, LEAST = 0.18, 0.22, 0.042, 1000

FRAME = ["scan_id", "frame_id"]
POSE = "rotation array<double>, shift array<double>"


def _refit(cov: pd.Series, start: pd.Series, goal: pd.Series, rotation: pd.Series, shift: pd.Series) -> pd.DataFrame:
    """The rigid motion that takes the pairs' first points to their second, after the motion so far."""
    out = []
    for c, a, b, r, t in zip(cov, start, goal, rotation, shift):
        u, _, vt = np.linalg.svd(np.array(c, float).reshape(3, 3))
        turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt
        move = np.array(b, float) - turn @ np.array(a, float)
        out.append(((turn @ np.array(r, float).reshape(3, 3)).ravel().tolist(), (turn @ np.array(t, float) + move).tolist()))
    return pd.DataFrame(out, columns=["rotation", "shift"])


def _moved(c: int) -> Column:
    return F.col("rotation")[3 * c] * F.col("x") + F.col("rotation")[3 * c + 1] * F.col("y") + F.col("rotation")[3 * c + 2] * F.col("z") + F.col("shift")[c]


def _partners(points: DataFrame, base: DataFrame, radius: float) -> DataFrame:
    """(scan_id, frame_id, point_id, d2, x, y, z, bx, by, bz): the nearest base point of the scan within ``radius``; the lower base_id wins ties."""
    left = points.select("scan_id", "frame_id", "point_id", *"xyz", *(spatial.cell(c, radius).alias(f"g{c}") for c in "xyz"))
    for c in "xyz":
        left = left.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + j for j in (-1, 0, 1)))))
    d2 = sum(((F.col(c) - F.col(f"b{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("bx")) ** 2)
    met = left.join(base, ["scan_id", "gx", "gy", "gz"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    best = F.min_by(F.struct("d2", *"xyz", "bx", "by", "bz"), F.struct("d2", "base_id"))
    return met.groupBy(*FRAME, "point_id").agg(best.alias("m")).select(*FRAME, "point_id", "m.*")


def _celled(base: DataFrame, radius: float) -> DataFrame:
    return settled(base.select("scan_id", F.col("point_id").alias("base_id"), *(F.col(c).cast("double").alias(f"b{c}") for c in "xyz"), *(spatial.cell(c, radius).alias(f"g{c}") for c in "xyz")))


def register(frames: DataFrame, base: DataFrame, radius: float = 0.065, rounds: int = 18, voxel: float | None = 0.025, near: float = 0.06, least: int = LEAST, overlap: float = OVERLAP, fitness: float = FITNESS, rmse: float = RMSE, still: float = 1e-6) -> DataFrame:
    """(scan_id, frame_id, points, overlap, fitness, rmse, rounds, rotation, shift, accepted, reason): a row per frame.

    ``frames`` (scan_id, frame_id, point_id, x, y, z), ``base`` (scan_id,
    point_id, x, y, z). A frame is tried if it has ``least`` points and the
    share of them within ``near`` of the base is at least ``overlap``. Then its
    points, one mean for each ``voxel`` (all where that is None), are moved
    until ``fitness`` (share of them with a partner within ``radius``) and
    ``rmse`` (of the partners' distances) change by less than ``still``, at
    most ``rounds`` times. ``reason`` is the first gate that a frame fails:
    too_few_points, low_overlap, low_fitness, high_rmse; numbers that were not
    reached are null. Rotation and shift take the frame's points to the base;
    they are those of standing still where a frame was not tried. Points with
    a null or non-finite coordinate count for nothing; no frames give no rows.
    """
    f = settled(frames.filter(spatial.finite("x", "y", "z")).select("scan_id", "frame_id", "point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    b = base.filter(spatial.finite("x", "y", "z"))
    close = _partners(f, _celled(b, near), near).groupBy(*FRAME).agg(F.count("*").alias("close"))
    sizes = f.groupBy("scan_id", "frame_id").agg(F.count("*").alias("points")).join(close, FRAME, "left")
    sizes = settled(sizes.select("scan_id", "frame_id", "points", (F.coalesce("close", F.lit(0)) / F.col("points")).alias("overlap")))
    tried = sizes.filter((F.col("points") >= least) & (F.col("overlap") >= overlap)).select("scan_id", "frame_id")
    source = f.join(tried, ["scan_id", "frame_id"], "left_semi")
    if voxel is not None:
        cells = [spatial.cell(c, voxel).alias(f"v{c}") for c in "xyz"]
        source = source.groupBy("scan_id", "frame_id", *cells).agg(*(F.avg(c).alias(c) for c in "xyz"), F.min("point_id").alias("point_id"))
    source = settled(source.select("scan_id", "frame_id", "point_id", *"xyz"))
    target = _celled(b, radius)
    stand = {"rotation": F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))), "shift": F.array(*[F.lit(0.0)] * 3)}
    none = F.lit(None).cast("double")
    active = settled(source.groupBy(*FRAME).agg(F.count("*").alias("total")).withColumns(stand | {"fitness": none, "rmse": none}))
    ended = active.limit(0).select(*FRAME, "fitness", "rmse", F.lit(0).alias("rounds"), "rotation", "shift")
    for k in range(rounds + 1):
        moved = source.join(active.select(*FRAME, "rotation", "shift"), FRAME).select("scan_id", "frame_id", "point_id", *(_moved(i).alias(c) for i, c in enumerate("xyz")))
        pairs = _partners(moved, target, radius)
        sums = pairs.groupBy(*FRAME).agg(
            F.count("*").alias("n"), F.avg("d2").alias("d2"), F.array(*(F.covar_pop(f"b{a}", c) for a in "xyz" for c in "xyz")).alias("cov"), F.array(*(F.avg(c) for c in "xyz")).alias("start"), F.array(*(F.avg(f"b{c}") for c in "xyz")).alias("goal"),
        )
        now = active.join(sums, FRAME, "left").withColumns({"now": F.coalesce("n", F.lit(0)) / F.col("total"), "off": F.sqrt("d2")})
        stays = F.coalesce((F.abs(F.col("now") - F.col("fitness")) < still) & (F.abs(F.col("off") - F.col("rmse")) < still), F.lit(False))
        now = settled(now.withColumn("over", stays | (F.coalesce("n", F.lit(0)) < 3) | F.lit(k == rounds)))
        ended = ended.union(now.filter("over").select(*FRAME, F.col("now").alias("fitness"), F.col("off").alias("rmse"), F.lit(k).alias("rounds"), "rotation", "shift"))
        fit = F.pandas_udf(_refit, POSE)("cov", "start", "goal", "rotation", "shift")
        active = settled(now.filter("not over").select(*FRAME, "total", fit.alias("pose"), F.col("now").alias("fitness"), F.col("off").alias("rmse")).select(*FRAME, "total", "pose.*", "fitness", "rmse"))
        if active.isEmpty():
            break
    j = sizes.join(ended, FRAME, "left")
    reason = F.when(F.col("points") < least, "too_few_points").when(F.col("overlap") < overlap, "low_overlap").when(F.col("fitness") < fitness, "low_fitness").when(F.col("rmse") > rmse, "high_rmse")
    return j.select("scan_id", "frame_id", "points", "overlap", "fitness", "rmse", "rounds", *(F.coalesce(F.col(c), v).alias(c) for c, v in stand.items()), reason.isNull().alias("accepted"), reason.alias("reason"))


def applied(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """The points of the accepted frames, moved to the base."""
    good = poses.filter("accepted").select(*FRAME, "rotation", "shift")
    rest = [c for c in frames.columns if c not in "xyz"]
    return frames.join(good, FRAME).select(*rest, *(_moved(i).alias(c) for i, c in enumerate("xyz")))
