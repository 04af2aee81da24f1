"""Boxes fitted to their detections in several views, within bounds and robustly.

Parameters of a box are place (x, y), turn (degrees) and the logarithm of the
height's factor. Each round projects the boxes of all tracks and starts at once:
every observation adds its part of the cost, gradient and curvature, Spark sums
those for each fit, and a small step on four parameters follows for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitrace.session import settled

#: The loss's scale; how far a box may move and its height change; weights of anchor and height; what an unseen box costs.
SCALE, REACH, LOWEST, HIGHEST, UNSEEN = 0.08, 0.28, 0.78, 1.15, 3.0
ANCHOR, HEIGHT = 0.45 / 0.20, 0.35 / 0.18
STARTS = (0.0, 90.0, -90.0, 180.0)

_SIGNS = np.array([(a, b, c) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)])
_CAMERA = ("rotation", "px", "py", "pz", "fx", "fy", "ox", "oy", "width", "height")
_SEEN = ("x1", "y1", "x2", "y2")


def projected(params: np.ndarray, size: np.ndarray, camera: dict[str, np.ndarray]) -> np.ndarray:
    """(n, 4): least and greatest pixel of each box; not a number where fewer than four corners are before the camera."""
    tall = size[:, 2] * np.exp(params[:, 3])
    local = _SIGNS[None] * np.stack([size[:, 0], size[:, 1], tall], axis=1)[:, None]
    c, s = np.cos(np.radians(params[:, 2]))[:, None], np.sin(np.radians(params[:, 2]))[:, None]
    world = np.stack([c * local[..., 0] - s * local[..., 1] + params[:, :1], s * local[..., 0] + c * local[..., 1] + params[:, 1:2], local[..., 2] + tall[:, None] / 2], axis=-1)
    world -= np.stack([camera["px"], camera["py"], camera["pz"]], axis=1)[:, None]
    seen = np.einsum("nij,nkj->nki", camera["rotation"], world)
    depth = seen[..., 2]
    ahead = depth > 0.05
    safe = np.where(ahead, depth, 1.0)
    uv = np.stack([camera[f][:, None] * seen[..., k] / safe + camera[o][:, None] for k, (f, o) in enumerate((("fx", "ox"), ("fy", "oy")))], axis=-1)
    low, high = np.where(ahead[..., None], uv, np.inf).min(axis=1), np.where(ahead[..., None], uv, -np.inf).max(axis=1)
    return np.where((ahead.sum(axis=1) >= 4)[:, None], np.hstack([low, high]), np.nan)


def residuals(box: np.ndarray, seen: np.ndarray, camera: dict[str, np.ndarray]) -> np.ndarray:
    """(n, 4): differences of the edges as shares of the image; not a number for edges at the image's border.

    Such an edge is censored: the thing goes on beyond the image. Where all four
    are, the difference of the middles counts in the first two places. A box
    that isn't before the camera costs ``UNSEEN`` for each that counts.
    """
    w, h = camera["width"], camera["height"]
    free = np.stack([seen[:, 0] > 2, seen[:, 1] > 2, seen[:, 2] < w - 3, seen[:, 3] < h - 3], axis=1)
    off = (box - seen) / np.maximum(w, h)[:, None]
    out = np.where(free, off, np.nan)
    clipped = ~free.any(axis=1)
    out[clipped, :2] = ((off[:, :2] + off[:, 2:]) / 2)[clipped]
    counts = free | (clipped[:, None] & np.array([True, True, False, False]))
    return np.where(counts & np.isnan(box[:, :1]), UNSEEN, out)


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    camera = {c: frame[c].to_numpy(float) for c in _CAMERA[1:]} | {"rotation": np.stack(frame["rotation"].to_numpy()).astype(float).reshape(-1, 3, 3)}
    return np.stack(frame["at"].to_numpy()).astype(float), frame[["sx", "sy", "sz"]].to_numpy(float), frame[list(_SEEN)].to_numpy(float), camera


_H = (1e-4, 1e-4, 1e-2, 1e-4)
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
#: cost, squares, count, gradient (4), curvature (10).
SUMS = 3 + 4 + len(_PAIRS)


def _parts(batch: pd.DataFrame) -> pd.Series:
    """What each observation adds to the sums of its fit."""
    at, size, seen, camera = _arrays(batch)
    r = residuals(projected(at, size, camera), seen, camera)
    slopes = []
    for k, h in enumerate(_H):
        ends = []
        for sign in (1, -1):
            moved = at.copy()
            moved[:, k] += sign * h
            ends.append(residuals(projected(moved, size, camera), seen, camera))
        slopes.append((ends[0] - ends[1]) / (2 * h))
    used = ~np.isnan(r)
    r, jac = np.where(used, r, 0.0), np.where(used[:, None], np.nan_to_num(np.stack(slopes, axis=1)), 0.0)
    z = (r / SCALE) ** 2
    weight = 1 / np.sqrt(1 + z)
    columns = [(SCALE**2 * (np.sqrt(1 + z) - 1)).sum(axis=1), (r**2).sum(axis=1), used.sum(axis=1), *((weight * r * jac[:, k]).sum(axis=1) for k in range(4)), *((weight * jac[:, i] * jac[:, j]).sum(axis=1) for i, j in _PAIRS)]
    return pd.Series(list(np.stack(columns, axis=1)))


def _with_priors(sums: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """``sums`` with the pull of the anchor and of the height added."""
    out = sums.copy()
    for k, (value, slope) in enumerate(((at[:, 0] - anchor[:, 0], ANCHOR), (at[:, 1] - anchor[:, 1], ANCHOR), (at[:, 3], HEIGHT))):
        k, r = (0, 1, 3)[k], value * slope
        z = (r / SCALE) ** 2
        weight = 1 / np.sqrt(1 + z)
        out[:, 0] += SCALE**2 * (np.sqrt(1 + z) - 1)
        out[:, 1] += r**2
        out[:, 2] += 1
        out[:, 3 + k] += weight * r * slope
        out[:, 7 + _PAIRS.index((k, k))] += weight * slope**2
    return out


STATE = "track_id long, start int, at array<double>, best array<double>, sums array<double>, damping double, over boolean"


def _stepped(batch: pd.DataFrame) -> pd.DataFrame:
    """The tried place is kept if it costs less, and the next one tried: a damped step that stays within the bounds."""
    out = []
    tried = np.stack(batch["tried"].to_numpy()).astype(float)
    at, anchor = np.stack(batch["at"].to_numpy()).astype(float), batch[["ax", "ay"]].to_numpy(float)
    tried = _with_priors(tried, at, anchor)
    low, high = (np.stack(batch[c].to_numpy()).astype(float) for c in ("low", "high"))
    for i, row in enumerate(batch.itertuples()):
        best, sums, damping = row.best, row.sums, row.damping
        gain = np.inf if sums is None else sums[0] - tried[i, 0]
        if gain > 0:
            best, sums, damping = at[i], tried[i], max(damping / 3, 1e-9)
        else:
            damping *= 4
        best, sums = np.array(best, float), np.array(sums, float)
        g, h = sums[3:7], np.zeros((4, 4))
        for (a, b), v in zip(_PAIRS, sums[7:]):
            h[a, b] = h[b, a] = v
        free = ~((best <= low[i]) & (g > 0) | (best >= high[i]) & (g < 0))
        step = np.zeros(4)
        if free.any():
            part = h[np.ix_(free, free)]
            step[free] = -np.linalg.solve(part + damping * np.diag(np.maximum(np.diag(part), 1e-9)) + 1e-15 * np.eye(len(part)), g[free])
        new = np.clip(best + step, low[i], high[i])
        small = (abs(new - best) <= 1e-6 * (1e-2 + abs(best))).all() or 0 < gain < 1e-6 * sums[0] or damping > 1e7
        out.append((row.track_id, row.start, new, best, sums, damping, bool(small)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])


def fit_boxes(tracks: DataFrame, observations: DataFrame, cameras: DataFrame, rounds: int = 40) -> DataFrame:
    """(track_id, status, views, score, cx, cy, yaw, height): the best fit of each track; ``insufficient`` under two views.

    ``tracks`` (track_id, scan_id, ax, ay, sx, sy, sz, yaw, lo_x, lo_y, hi_x,
    hi_y): anchor, sizes, first turn in degrees and the room; ``observations``
    (track_id, view_id, x1, y1, x2, y2); ``cameras`` (scan_id, view_id, fx, fy,
    ox, oy, rotation world to camera, px, py, pz, width, height). Observations
    of unknown views don't count. Five first turns are tried; the one whose mean
    square of the residuals is least wins, then the first. A box stays within
    0.28 of its anchor and 0.05 inside the room, its height within 0.78 to 1.15
    of what was measured; where a room is too small for that, the anchor stays.
    """
    seen = observations.join(tracks.select("track_id", "scan_id", "sx", "sy", "sz"), "track_id").join(cameras, ["scan_id", "view_id"])
    seen = settled(seen.select("track_id", *(F.col(c).cast("double").alias(c) for c in (*_SEEN, "sx", "sy", "sz", *_CAMERA[1:])), "rotation"))
    views = tracks.select("track_id", "sz").join(seen.groupBy("track_id").agg(F.count("*").alias("views")), "track_id", "left").select("track_id", "sz", F.coalesce("views", F.lit(0)).alias("views"))
    bound = lambda c, k, sign: (F.greatest if sign < 0 else F.least)(F.col(f"{k}_{c}") - sign * 0.05, F.col(f"a{c}") + sign * REACH)
    ends = [(F.least(bound(c, "lo", -1), F.col(f"a{c}")), F.greatest(bound(c, "hi", 1), F.col(f"a{c}"))) for c in "xy"]
    enough = tracks.join(views.filter("views >= 2").select("track_id"), "track_id", "left_semi")
    plan = settled(enough.select("track_id", F.col("ax").cast("double").alias("ax"), F.col("ay").cast("double").alias("ay"), "yaw", F.array(ends[0][0], ends[1][0], F.lit(-180.0), F.lit(float(np.log(LOWEST)))).alias("low"), F.array(ends[0][1], ends[1][1], F.lit(180.0), F.lit(float(np.log(HIGHEST)))).alias("high")))
    turns = F.array(F.greatest(F.least(F.col("yaw").cast("double"), F.lit(180.0)), F.lit(-180.0)), *(F.lit(t) for t in STARTS))
    begun = plan.select("track_id", "ax", "ay", F.posexplode(turns).alias("start", "turn"))
    none = F.lit(None).cast("array<double>")
    active = settled(begun.select("track_id", "start", F.array("ax", "ay", "turn", F.lit(0.0)).alias("at"), none.alias("best"), none.alias("sums"), F.lit(1e-3).alias("damping"), F.lit(False).alias("over")))
    ended = active.limit(0).select("track_id", "start", "best", "sums")
    part = F.pandas_udf(lambda batch: _parts(batch), "array<double>")
    for k in range(rounds):
        met = active.select("track_id", "start", "at").join(seen, "track_id")
        added = met.select("track_id", "start", part(F.struct("at", "sx", "sy", "sz", *_SEEN, *_CAMERA)).alias("p"))
        sums = added.groupBy("track_id", "start").agg(F.array(*(F.sum(F.col("p")[i]) for i in range(SUMS))).alias("tried"))
        state = active.drop("over").join(sums, ["track_id", "start"]).join(plan.select("track_id", "ax", "ay", "low", "high"), "track_id")
        after = settled(state.mapInPandas(lambda batches: map(_stepped, batches), STATE))
        done = after if k == rounds - 1 else after.filter("over")
        ended = ended.union(done.select("track_id", "start", "best", "sums"))
        active = after.filter("not over")
        if active.isEmpty():
            break
    score = F.col("sums")[1] / F.col("sums")[2]
    best = ended.groupBy("track_id").agg(F.min_by(F.struct("best", score.alias("score")), F.struct(score.alias("s"), "start")).alias("b")).select("track_id", "b.*")
    j = views.join(best, "track_id", "left")
    at = F.col("best")
    return j.select("track_id", F.when(at.isNull(), "insufficient").otherwise("fitted").alias("status"), "views", "score", at[0].alias("cx"), at[1].alias("cy"), at[2].alias("yaw"), (F.col("sz") * F.exp(at[3])).alias("height"))


def reprojection(boxes: DataFrame, cameras: DataFrame, seen: DataFrame) -> DataFrame:
    """(track_id, view_id, u0, v0, u1, v1, r0, r1, r2, r3): each box as its views see it, and the residuals against what was detected.

    ``boxes`` (track_id, scan_id, cx, cy, yaw in degrees, sx, sy, sz) stand on
    the floor; the others as in ``fit_boxes``. Nulls are edges that don't count,
    or boxes that aren't before the camera.
    """
    rows = seen.join(boxes, "track_id").join(cameras, ["scan_id", "view_id"])

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        at, size, found, camera = _arrays(batch)
        box = projected(at, size, camera)
        return pd.DataFrame(np.hstack([box, residuals(box, found, camera)]), columns=["u0", "v0", "u1", "v1", "r0", "r1", "r2", "r3"])

    fields = ", ".join(f"{c} double" for c in ("u0", "v0", "u1", "v1", "r0", "r1", "r2", "r3"))
    given = F.struct(F.array("cx", "cy", "yaw", F.lit(0.0)).alias("at"), "sx", "sy", "sz", *_SEEN, *_CAMERA)
    made = rows.select("track_id", "view_id", F.pandas_udf(run, fields)(given).alias("p")).select("track_id", "view_id", "p.*")
    return made.select("track_id", "view_id", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("u0", "v0", "u1", "v1", "r0", "r1", "r2", "r3")))
