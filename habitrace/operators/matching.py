"""Pairs of images by their matched keypoints: ratio test, homographies by drawn quadruples, best reference.

Quadruples are drawn by hashes, their homographies solved in Arrow batches, and
the votes of a pair's matches counted block by block and added up, so a pair
with any number of matches is never one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitrace.session import settled

#: Ratio of the nearest to the second match, reprojection error in pixels, least matches and inliers.
RATIO, ERROR, LEAST_MATCHES, LEAST_INLIERS = 0.72, 4.0, 8, 10
BLOCK = 4096
PAIR = ["query_id", "ref_id"]


def good_matches(candidates: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(query_id, ref_id, key_id, x, y, u, v): keypoints whose nearest candidate is clearly nearer than the second.

    ``candidates`` (query_id, ref_id, key_id, other_id, distance, x, y, u, v).
    A keypoint with one candidate only has no match. Ties of distance go to the
    lower other_id.
    """
    order = Window.partitionBy(*PAIR, "key_id").orderBy("distance", "other_id")
    two = candidates.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    met = two.groupBy(*PAIR, "key_id").agg(*(first(c).alias(c) for c in ("distance", *"xyuv")), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    return met.filter(F.col("distance") < ratio * F.col("second")).select(*PAIR, "key_id", *"xyuv")


def _solved(quads: pd.Series) -> pd.Series:
    """The homography (nine numbers, the last 1) of four matches each, None where three of them are in line or equal."""
    out = []
    for quad in quads:
        q = np.stack([np.array(p, float) for p in quad])
        rows = np.zeros((8, 8))
        for k, (x, y, u, v) in enumerate(q):
            rows[2 * k] = [x, y, 1, 0, 0, 0, -u * x, -u * y]
            rows[2 * k + 1] = [0, 0, 0, x, y, 1, -v * x, -v * y]
        flat = min(abs(np.linalg.det(np.column_stack([np.delete(q, k, axis=0)[:, c : c + 2], np.ones(3)]))) for k in range(4) for c in (0, 2))
        out.append(None if flat < 1e-6 else [*np.linalg.solve(rows, q[:, 2:].ravel()).tolist(), 1.0])
    return pd.Series(out)


def _agreeing(h: np.ndarray, xyuv: np.ndarray, error: float) -> np.ndarray:
    """(trials, matches): which matches each homography takes to within ``error``."""
    to = np.einsum("tij,nj->tni", h.reshape(-1, 3, 3), np.column_stack([xyuv[:, :2], np.ones(len(xyuv))]))
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.hypot(to[..., 0] / to[..., 2] - xyuv[:, 2], to[..., 1] / to[..., 2] - xyuv[:, 3])
    return (off <= error) & (abs(to[..., 2]) > 1e-12)


def homographies(matches: DataFrame, trials: int = 300, error: float = ERROR, least: int = LEAST_MATCHES, seed: int = 7) -> DataFrame:
    """(query_id, ref_id, matches, inliers, h): per pair the drawn homography that most matches agree with.

    ``matches`` as of ``good_matches``. Pairs with fewer than ``least`` matches
    have no inliers and a null ``h``, as have pairs whose every draw is
    degenerate. The first trial wins ties. Matches with a null coordinate count
    for nothing.
    """
    order = Window.partitionBy(*PAIR).orderBy("key_id", *"xyuv")
    full = matches.dropna(subset=list("xyuv"))
    placed = settled(full.select(*PAIR, "key_id", *(F.col(c).cast("double").alias(c) for c in "xyuv")).withColumn("place", (F.row_number().over(order) - 1).cast("long")))
    sizes = settled(placed.groupBy(*PAIR).agg(F.count("*").alias("matches")))
    asked = sizes.filter(F.col("matches") >= least).select("*", F.explode(F.sequence(F.lit(0), F.lit(4 * trials - 1))).alias("i"))
    drawn = asked.select(*PAIR, F.floor(F.col("i") / 4).cast("int").alias("trial"), (F.col("i") % 4).alias("k"), F.pmod(F.xxhash64(*PAIR, "i", F.lit(seed)), F.col("matches")).alias("place"))
    quads = drawn.join(placed, [*PAIR, "place"]).groupBy(*PAIR, "trial").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.array(*"xyuv").alias("p")))), lambda s: s["p"]).alias("q"))
    solved = quads.select(*PAIR, "trial", F.pandas_udf(_solved, "array<double>")("q").alias("h")).filter("h is not null")
    drawn_h = settled(solved.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("trial", "h"))).alias("hs")))
    blocks = placed.groupBy(*PAIR, F.floor(F.col("place") / BLOCK).alias("block")).agg(F.flatten(F.collect_list(F.array(*"xyuv"))).alias("m"))

    def votes(m: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([_agreeing(np.array(b, float), np.array(a, float).reshape(-1, 4), error).sum(axis=1).tolist() for a, b in zip(m, h)])

    met = blocks.join(drawn_h, PAIR).select(*PAIR, "hs", F.pandas_udf(votes, "array<long>")("m", F.flatten(F.transform("hs", lambda s: s["h"]))).alias("n"))
    each = met.select(*PAIR, F.explode(F.arrays_zip(F.transform("hs", lambda s: s["trial"]).alias("trial"), F.col("n").alias("n"))).alias("v")).select(*PAIR, "v.*")
    best = each.groupBy(*PAIR, "trial").agg(F.sum("n").alias("inliers")).groupBy(*PAIR).agg(F.max_by(F.struct("trial", "inliers"), F.struct("inliers", (-F.col("trial")).alias("t"))).alias("b")).select(*PAIR, "b.*")
    chosen = best.join(drawn_h, PAIR).select(*PAIR, "inliers", F.filter("hs", lambda s: s["trial"] == F.col("trial"))[0]["h"].alias("h"))
    return sizes.join(chosen, PAIR, "left").select(*PAIR, "matches", F.coalesce("inliers", F.lit(0)).alias("inliers"), "h")


def anchors(scores: DataFrame, least: int = LEAST_INLIERS) -> DataFrame:
    """(query_id, ref_id, matches, inliers): the reference image that each query agrees with best, if by ``least`` inliers.

    More inliers win, then more matches, then the lower ref_id.
    """
    order = F.struct("inliers", "matches", (-F.col("ref_id")).alias("r"))
    best = scores.groupBy("query_id").agg(F.max_by(F.struct("ref_id", "matches", "inliers"), order).alias("b")).select("query_id", "b.*")
    return best.filter(F.col("inliers") >= least)
