"""Cameras of video frames from pixels with known places in the world.

All frames are solved at once. Draws of four pixels are made by hashes, their
poses solved in Arrow batches, and the votes of a frame's pixels counted block
by block; the best draw is then refined over all pixels that agree, where a
round adds up one 6 x 6 system a frame. Two passes: the first gives each frame's
focal length, the second solves all frames of a scan with their common one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitrace.session import settled

#: First focal length and middle of the images, least confidence, pixels and inliers of a frame, reprojection error of an inlier and of a frame's median, range of a frame's and of the common focal length, least frames.
FIRST_FOCAL, MIDDLE, CONFIDENCE, LEAST_POINTS, LEAST_INLIERS, ERROR, MEDIAN_ERROR, FRAME_FOCAL, COMMON_FOCAL, LEAST_FRAMES = 280.0, (112.0, 112.0), 12.0, 3000, 800, 4.0, 2.5, (100.0, 800.0), (200.0, 420.0), 30
#: Weights of sharpness and inliers in a frame's quality.
SHARP, AGREEING = 0.25, 0.15
BLOCK, AT_ONCE = 2048, 64
FRAME = ["scan_id", "frame_id"]
SUMS = 28


def _kabsch(world: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (n, 3, 3) and shifts (n, 3) that take triples of the world to triples before the camera."""
    a, b = world.mean(axis=1, keepdims=True), seen.mean(axis=1, keepdims=True)
    u, _, vt = np.linalg.svd(np.swapaxes(seen - b, 1, 2) @ (world - a))
    flip = np.ones((len(u), 3))
    flip[:, 2] = np.sign(np.linalg.det(u @ vt))
    turn = (u * flip[:, None, :]) @ vt
    return turn, b[:, 0] - np.einsum("nij,nj->ni", turn, a[:, 0])


def _three_point(quads: np.ndarray) -> np.ndarray:
    """(n, 12) poses, rotation then shift, of (n, 4) rays (a, b, 1) and places; NaN where there is none.

    Three rays and the distances of their places give a quartic for the ratio
    of the depths of the third and the first; the fourth ray chooses among its
    roots.
    """
    rays = np.concatenate([quads[..., :2], np.ones(quads.shape[:2] + (1,))], axis=-1)
    rays /= np.linalg.norm(rays, axis=-1, keepdims=True)
    world = quads[..., 2:]
    apart = lambda i, j: ((world[:, i] - world[:, j]) ** 2).sum(axis=1)
    angle = lambda i, j: (rays[:, i] * rays[:, j]).sum(axis=1)
    a, b, c = apart(1, 2), apart(0, 2), apart(0, 1)
    ca, cb, cc = angle(1, 2), angle(0, 2), angle(0, 1)
    out = np.full((len(quads), 12), np.nan)
    with np.errstate(all="ignore"):
        d, p, q = (a - c) / b, (a + c) / b, c / b
        terms = [
            (d - 1) ** 2 - 4 * q * ca**2,
            4 * (d * (1 - d) * cb - (1 - p) * ca * cc + 2 * q * ca**2 * cb),
            2 * (d**2 - 1 + 2 * d**2 * cb**2 + 2 * (1 - q) * ca**2 - 4 * p * ca * cb * cc + 2 * (1 - a / b) * cc**2),
            4 * (-d * (1 + d) * cb + 2 * a / b * cc**2 * cb - (1 - p) * ca * cc),
            (1 + d) ** 2 - 4 * a / b * cc**2,
        ]
        monic = np.stack(terms[1:], axis=1) / terms[0][:, None]
        good = np.flatnonzero(np.isfinite(monic).all(axis=1))
        if not len(good):
            return out
        companion = np.zeros((len(good), 4, 4))
        companion[:, 1:, :3] = np.eye(3)
        companion[:, 0] = -monic[good]
        roots = np.linalg.eigvals(companion)
        v = np.where(abs(roots.imag) < 1e-6 * (1 + abs(roots.real)), roots.real, np.nan)
        of = lambda x: x[good][:, None]
        u = ((of(d) - 1) * v**2 - 2 * of(d) * of(cb) * v + 1 + of(d)) / (2 * (of(cc) - v * of(ca)))
        first = np.sqrt(of(b) / (1 + v**2 - 2 * v * of(cb)))
        depth = np.stack([first, u * first, v * first], axis=2)
    which, root = np.nonzero(np.isfinite(depth).all(axis=2) & (depth > 0).all(axis=2))
    if not len(which):
        return out
    row = good[which]
    turn, shift = _kabsch(world[row, :3], rays[row, :3] * depth[which, root][:, :, None])
    ahead = np.einsum("nij,nj->ni", turn, world[row, 3]) + shift
    with np.errstate(all="ignore"):
        off = np.where(ahead[:, 2] > 0, np.hypot(ahead[:, 0] / ahead[:, 2] - quads[row, 3, 0], ahead[:, 1] / ahead[:, 2] - quads[row, 3, 1]), np.inf)
    for k in np.lexsort((root, off, row))[::-1]:
        if np.isfinite(off[k]):
            out[row[k]] = np.concatenate([turn[k].ravel(), shift[k]])
    return out


def _solved(quads: pd.Series) -> pd.Series:
    poses = _three_point(np.array([[list(p) for p in q] for q in quads], float))
    return pd.Series([p.tolist() if np.isfinite(p).all() else None for p in poses])


def _offsets(poses: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places before each camera (t, n, 3), and how far each is seen from its ray (t, n, 2); infinite behind the camera."""
    before = np.einsum("tij,nj->tni", poses[:, :9].reshape(-1, 3, 3), rows[:, 2:]) + poses[:, None, 9:]
    ahead = before[..., 2:] > 1e-9
    return before, np.where(ahead, rows[:, :2] - before[..., :2] / np.where(ahead, before[..., 2:], 1.0), np.inf)


def _agreeing(poses: np.ndarray, rows: np.ndarray, error: float) -> np.ndarray:
    """How many rows each pose agrees with."""
    parts = [(np.hypot(*np.moveaxis(_offsets(poses[k : k + AT_ONCE], rows)[1], -1, 0)) <= error).sum(axis=1) for k in range(0, len(poses), AT_ONCE)]
    return np.concatenate(parts)


def _system(pose: np.ndarray, rows: np.ndarray, error: float) -> np.ndarray:
    """Inliers, upper triangle of the normal matrix, and its right side, for a small turn and shift of ``pose``."""
    before, off = _offsets(pose[None], rows)
    inlier = np.hypot(off[0, :, 0], off[0, :, 1]) <= error
    at, r = before[0][inlier], off[0][inlier]
    turned = at - pose[9:]
    one, zero = 1 / at[:, 2], np.zeros(len(at))
    total = np.zeros(SUMS)
    total[0] = len(at)
    for k, to in enumerate((np.stack([one, zero, -at[:, 0] * one**2], 1), np.stack([zero, one, -at[:, 1] * one**2], 1))):
        j = np.hstack([np.cross(turned, to), to])
        total[1:22] += (j.T @ j)[np.triu_indices(6)]
        total[22:] += j.T @ r[:, k]
    return total


def _stepped(pose: pd.Series, sums: pd.Series) -> pd.Series:
    """The poses after a Gauss-Newton step; as they were where the system has no answer."""
    out = []
    for p, s in zip(pose, sums):
        p, s = np.array(p, float), np.array(s, float)
        full = np.zeros((6, 6))
        full[np.triu_indices(6)] = s[1:22]
        full += np.triu(full, 1).T
        if s[0] >= 4 and np.linalg.matrix_rank(full) == 6:
            step = np.linalg.solve(full, s[22:])
            size = np.linalg.norm(step[:3])
            axis = step[:3] / size if size > 1e-15 else np.zeros(3)
            k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
            turn = np.eye(3) + np.sin(size) * k + (1 - np.cos(size)) * k @ k
            p = np.concatenate([(turn @ p[:9].reshape(3, 3)).ravel(), p[9:] + step[3:]])
        out.append(p.tolist())
    return pd.Series(out)


def _usable(seen: DataFrame, confidence: float) -> Column:
    finite = F.lit(True)
    for c in "uvxyz":
        value = F.col(c).cast("double")
        finite = finite & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.coalesce(finite & (F.col("conf") > confidence), F.lit(False))


def frame_poses(seen: DataFrame, focals: DataFrame | float = FIRST_FOCAL, middle: tuple[float, float] = MIDDLE, confidence: float = CONFIDENCE, least_points: int = LEAST_POINTS, least_inliers: int = LEAST_INLIERS, error: float = ERROR, median_error: float = MEDIAN_ERROR, focal_range: tuple[float, float] | None = FRAME_FOCAL, trials: int = 300, rounds: int = 4, seed: int = 11) -> DataFrame:
    """(scan_id, frame_id, points, inliers, focal, error, rotation, shift, accepted, reason): a row per frame.

    ``seen`` (scan_id, frame_id, point_id, u, v, x, y, z, conf): pixels and
    their places; rotation and shift take places to the camera. ``focals`` is
    one focal length or (scan_id, focal). ``focal`` is what the inliers say,
    the median of (u - middle) z / x; ``error`` their median distance in pixels.
    ``reason`` names the first gate that fails: few_points, few_inliers,
    odd_focal (not inside ``focal_range``, if one is given), reprojection.
    Pixels with a null or non-finite number or a confidence of at most
    ``confidence`` count for nothing, repeated ones each time. Places may lie in
    one plane, not in one line. Frames of scans without a focal length have
    no row, an empty table gives none.
    """
    told = seen.select(*FRAME, "point_id", *(F.col(c).cast("double").alias(c) for c in "uvxyz"), _usable(seen, confidence).alias("usable"))
    told = told.join(focals.select("scan_id", F.col("focal").alias("f")), "scan_id") if isinstance(focals, DataFrame) else told.withColumn("f", F.lit(float(focals)))
    sizes = settled(told.groupBy(*FRAME).agg(F.count_if("usable").alias("points"), F.max("f").alias("f")))
    order = Window.partitionBy(*FRAME).orderBy("point_id", *"uvxyz")
    rays = [((F.col("u") - middle[0]) / F.col("f")).alias("a"), ((F.col("v") - middle[1]) / F.col("f")).alias("b"), *"xyz"]
    asked = sizes.filter(F.col("points") >= max(least_points, 4))
    placed = settled(told.filter("usable").join(asked.select(*FRAME), FRAME, "left_semi").select(*FRAME, "f", F.array(*rays).alias("p"), (F.row_number().over(order) - 1).cast("long").alias("place")))
    blocks = settled(placed.groupBy(*FRAME, F.floor(F.col("place") / BLOCK).alias("block")).agg(F.flatten(F.collect_list("p")).alias("m"), F.max("f").alias("f")))

    drawn = asked.select(*FRAME, "points", F.explode(F.sequence(F.lit(0), F.lit(4 * trials - 1))).alias("i"))
    drawn = drawn.select(*FRAME, F.floor(F.col("i") / 4).cast("int").alias("trial"), (F.col("i") % 4).alias("k"), F.pmod(F.xxhash64(*FRAME, "i", F.lit(seed)), F.col("points")).alias("place"))
    quads = drawn.join(placed, [*FRAME, "place"]).groupBy(*FRAME, "trial").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias("q"))
    solved = quads.select(*FRAME, "trial", F.pandas_udf(_solved, "array<double>")("q").alias("h")).filter("h is not null")
    drawn_h = settled(solved.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("trial", "h"))).alias("hs")))

    def votes(m: pd.Series, f: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([_agreeing(np.array([list(x) for x in c], float), np.array(a, float).reshape(-1, 5), error / b).tolist() for a, b, c in zip(m, f, h)])

    def systems(m: pd.Series, f: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([_system(np.array(c, float), np.array(a, float).reshape(-1, 5), error / b).tolist() for a, b, c in zip(m, f, h)])

    met = blocks.join(drawn_h, FRAME).select(*FRAME, "hs", F.pandas_udf(votes, "array<long>")("m", "f", F.transform("hs", lambda s: s["h"])).alias("n"))
    each = met.select(*FRAME, F.explode(F.arrays_zip(F.transform("hs", lambda s: s["trial"]).alias("trial"), F.col("n").alias("n"))).alias("v")).select(*FRAME, "v.*")
    counted = each.groupBy(*FRAME, "trial").agg(F.sum("n").alias("n"))
    best = counted.groupBy(*FRAME).agg(F.max_by("trial", F.struct("n", (-F.col("trial")).alias("t"))).alias("trial"))
    poses = settled(best.join(drawn_h, FRAME).select(*FRAME, F.filter("hs", lambda s: s["trial"] == F.col("trial"))[0]["h"].alias("h")))
    for _ in range(rounds):
        parts = blocks.join(poses, FRAME).select(*FRAME, "h", F.pandas_udf(systems, "array<double>")("m", "f", "h").alias("s"))
        summed = parts.groupBy(*FRAME).agg(F.first("h").alias("h"), F.array(*(F.sum(F.col("s")[k]) for k in range(SUMS))).alias("s"))
        poses = settled(summed.select(*FRAME, F.pandas_udf(_stepped, "array<double>")("h", "s").alias("h")))

    p, h = F.col("p"), F.col("h")
    camera = [h[3 * k] * p[2] + h[3 * k + 1] * p[3] + h[3 * k + 2] * p[4] + h[9 + k] for k in range(3)]
    at = placed.join(poses, FRAME).select(*FRAME, "f", "p", *(c.alias(f"c{k}") for k, c in enumerate(camera)))
    near = at.filter("c2 > 1e-9").withColumn("off", F.col("f") * F.hypot(p[0] - F.col("c0") / F.col("c2"), p[1] - F.col("c1") / F.col("c2"))).filter(F.col("off") <= error)
    said = near.groupBy(*FRAME).agg(F.count("*").alias("inliers"), F.percentile("off", 0.5).alias("error"), F.percentile(F.col("f") * p[0] * F.col("c2") / (F.col("c0") + 1e-9), 0.5).alias("focal"))
    full = sizes.join(poses, FRAME, "left").join(said, FRAME, "left").withColumn("inliers", F.coalesce("inliers", F.lit(0)))
    reason = F.when(F.col("points") < max(least_points, 4), "few_points").when(F.col("inliers") < least_inliers, "few_inliers")
    if focal_range is not None:
        reason = reason.when(~((F.col("focal") > focal_range[0]) & (F.col("focal") < focal_range[1])), "odd_focal")
    reason = reason.when(F.col("error") > median_error, "reprojection")
    gated = full.withColumn("reason", reason)
    return gated.select(*FRAME, "points", "inliers", "focal", "error", F.slice("h", 1, 9).alias("rotation"), F.slice("h", 10, 3).alias("shift"), F.col("reason").isNull().alias("accepted"), "reason")


def common_focal(first: DataFrame, least: int = LEAST_FRAMES, low: float = COMMON_FOCAL[0], high: float = COMMON_FOCAL[1]) -> DataFrame:
    """(scan_id, frames, focal): the median focal length of a scan's frames, held between ``low`` and ``high``.

    ``first`` as of ``frame_poses``. Frames that only their reprojection
    rejects count, since their focal length was measured before that gate.
    With fewer than ``least`` frames the focal length is null, and
    the scan can't be recovered.
    """
    measured = F.coalesce(F.col("accepted") | (F.col("reason") == "reprojection"), F.lit(False))
    value = F.when(measured, F.col("focal"))
    found = first.groupBy("scan_id").agg(F.count(value).alias("frames"), F.percentile(value, 0.5).alias("m"))
    return found.select("scan_id", "frames", F.when(F.col("frames") >= least, F.least(F.greatest("m", F.lit(low)), F.lit(high))).alias("focal"))


def spread_over_time(first: DataFrame, most: int) -> DataFrame:
    """(scan_id, frame_id, role, rank): accepted frames as 'primary', one of each stretch of time, or 'backup'.

    ``first`` (scan_id, frame_id, inliers, error, sharpness, accepted). A scan
    with ``most`` frames or fewer keeps them all; a longer one is cut into
    ``most`` stretches of equal length, and the best frame of each is primary.
    Quality is 0.25 log(1 + sharpness) + 0.15 log(1 + inliers) - error; ties go
    to the earlier frame. Primary frames rank by time, backups by quality. With
    ``most`` of 0 or less all are backups, by time.
    """
    by_time = Window.partitionBy("scan_id").orderBy("frame_id")
    quality = SHARP * F.log1p(F.coalesce("sharpness", F.lit(0.0))) + AGREEING * F.log1p("inliers") - F.col("error")
    kept = first.filter("accepted").select("scan_id", "frame_id", quality.alias("quality"), (F.row_number().over(by_time) - 1).alias("at"), F.count("*").over(Window.partitionBy("scan_id")).alias("n"))
    if most <= 0:
        return kept.select("scan_id", "frame_id", F.lit("backup").alias("role"), (F.col("at") + 1).cast("long").alias("rank"))
    stretch = F.when(F.col("n") <= most, F.col("at")).otherwise(F.ceil((F.col("at") + 1) / (F.col("n") / most)) - 1)
    order = [F.desc_nulls_last("quality"), "frame_id"]
    placed = kept.withColumn("stretch", stretch).withColumn("k", F.row_number().over(Window.partitionBy("scan_id", "stretch").orderBy(*order)))
    roles = placed.withColumn("role", F.when(F.col("k") == 1, "primary").otherwise("backup"))
    held = F.when(F.col("role") == "backup", F.col("quality"))
    rank = F.row_number().over(Window.partitionBy("scan_id", "role").orderBy(F.desc_nulls_last(held), "frame_id"))
    return roles.select("scan_id", "frame_id", "role", rank.cast("long").alias("rank"))


def cameras(second: DataFrame, choice: DataFrame, alignment: DataFrame, most: int, least: int = LEAST_FRAMES) -> DataFrame:
    """(scan_id, frame_id, focal, inliers, error, rotation, position): the scan's cameras in aligned metres.

    ``second`` as of ``frame_poses`` with ``focal`` the common one, ``choice``
    as of ``spread_over_time``: accepted frames fill ``most`` places, primary
    ones first, then backups by rank. ``alignment`` (scan_id, turn: nine numbers
    of a rotation, scale, floor): the camera's rotation is taken to
    the aligned room, its place turned, lifted by the floor and scaled. Scans
    with fewer than ``least`` cameras have none.
    """
    filled = Window.partitionBy("scan_id").orderBy(F.when(F.col("role") == "primary", 0).otherwise(1), "rank")
    fit = second.filter("accepted").join(choice, FRAME).withColumn("place", F.row_number().over(filled)).filter(F.col("place") <= most)
    fit = fit.withColumn("cameras", F.count("*").over(Window.partitionBy("scan_id"))).filter(F.col("cameras") >= least).join(alignment, "scan_id")
    r, t, w = F.col("rotation"), F.col("shift"), F.col("turn")
    turned = [sum((r[3 * i + k] * w[3 * j + k] for k in (1, 2)), r[3 * i] * w[3 * j]) for i in range(3) for j in range(3)]
    own = [sum((r[3 * k + i] * t[k] for k in (1, 2)), r[i] * t[0]) for i in range(3)]
    place = [sum((w[3 * i + k] * own[k] for k in (1, 2)), w[3 * i] * own[0]) + (F.col("floor") if i == 2 else 0.0) for i in range(3)]
    return fit.select(*FRAME, "focal", "inliers", "error", F.array(*turned).alias("rotation"), F.array(*(-F.col("scale") * c for c in place)).alias("position"))
