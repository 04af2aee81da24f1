"""Camera views of an object or a scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.operators import planes, spatial
from habitrace.session import settled


def diversity(cameras: DataFrame, scale: Column) -> DataFrame:
    """(scan_id, widest, baseline, diversity) from camera positions around the origin (scan_id, x, y, z).

    The widest angle is that of the two directions farthest apart on the unit
    sphere: one ray comes nearest to another turned round. Scans whose rays
    all keep away from that are compared by cells. 90 degrees and a baseline of
    the object's ``scale`` count full.
    """
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    rays = settled(cameras.withColumn("_r", r).filter("_r > 1e-6").select("scan_id", F.lit(0).alias("point_id"), *((F.col(c) / F.col("_r")).alias(c) for c in "xyz")))
    turned = rays.select("scan_id", "point_id", F.lit(1).alias("side"), *((-F.col(c)).alias(c) for c in "xyz"))
    met = spatial.set_gaps(rays.withColumn("side", F.lit(0)).unionByName(turned), "side", 0.25, 0.25)
    apart = planes.widest_pairs(rays.join(met, "scan_id", "left_anti"))
    angle = met.select("scan_id", (2 * F.acos(F.col("gap") / 2)).alias("widest")).union(apart.select("scan_id", (2 * F.asin(F.least(F.col("widest") / 2, F.lit(1.0)))).alias("widest")))
    base = planes.widest_pairs(cameras).select("scan_id", F.col("widest").alias("baseline"))
    score = 0.7 * F.least(F.col("widest") / (math.pi / 2), F.lit(1.0)) + 0.3 * F.least(F.col("baseline") / scale, F.lit(1.0))
    return angle.join(base, "scan_id").withColumn("diversity", score)


def camera_pixel(model: Column, x: Column, y: Column, z: Column, f: float, cx: float, cy: float, k1: float, k2: float) -> tuple[Column, Column]:
    """Pixel of a point in camera coordinates under its camera model; NULL for a model that is not known.

    PINHOLE has no distortion, SIMPLE_RADIAL one term, RADIAL two.
    """
    u, v = x / z, y / z
    r2 = u * u + v * v
    factor = F.when(model == "PINHOLE", 1.0).when(model == "SIMPLE_RADIAL", 1 + k1 * r2).when(model == "RADIAL", 1 + k1 * r2 + k2 * r2 * r2)
    return f * factor * u + cx, f * factor * v + cy


def inverted(r: list[list[Column]], t: list[Column]) -> tuple[list[Column], list[Column]]:
    """Centre and viewing direction of a camera given as world to camera: -R't and R's third row."""
    centre = [-(r[0][k] * t[0] + r[1][k] * t[1] + r[2][k] * t[2]) for k in range(3)]
    return centre, [r[2][k] for k in range(3)]
