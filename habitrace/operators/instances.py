"""Geometry of instances: robust extents, fitted boxes and how far they can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.operators import planes, rooms, spatial, tracks
from habitrace.session import settled


def robust(points: DataFrame, quantile: float = 0.01) -> DataFrame:
    """(scan_id, n, kept, length, width, angle, low, high, stability) per instance (its ``scan_id``).

    Tails of each axis are trimmed, the largest dense component stays, its
    footprint is the least rectangle, its height the 2nd to 98th percentile;
    ``stability`` is the share of the points that are left.
    """
    q = lambda c: F.percentile(c, F.array(F.lit(quantile), F.lit(1 - quantile))).alias(f"q{c}")
    ends = points.groupBy("scan_id").agg(*(q(c) for c in "xyz"), F.count("*").alias("n"))
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(c).between(F.col(f"q{c}")[0], F.col(f"q{c}")[1])
    trimmed = settled(points.join(ends, "scan_id").filter(inside).select("scan_id", "point_id", "x", "y", "z"))
    parts = tracks.dense_components(trimmed).select("scan_id", "point_id", F.col("component").alias("cluster"))
    main = tracks.largest(parts).select("scan_id", "cluster")
    own = settled(trimmed.join(parts.join(main, ["scan_id", "cluster"]).select("scan_id", "point_id"), ["scan_id", "point_id"]))
    tall = own.groupBy("scan_id").agg(F.count("*").alias("kept"), F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("z"))
    j = planes.min_area_rectangles(own, ["scan_id"]).join(tall, "scan_id").join(ends.select("scan_id", "n"), "scan_id")
    return j.select("scan_id", "n", "kept", "length", "width", "angle", F.col("z")[0].alias("low"), F.col("z")[1].alias("high"), (F.col("kept") / F.col("n")).alias("stability"))


def fitted(points: DataFrame, k: int = 20, ratio: float = 1.6, least: int = 50, room_height: float = 2.6) -> DataFrame:
    """(scan_id, points, length, width, low, high, confidence, status, reason): the fit of each instance.

    Outliers go; under ``least`` points there is no fit. The box must not float
    (its bottom within max(0.60, a quarter of the room)), not rise over the
    room, and not be degenerate; what is plausible is verified from a
    confidence of 0.35 on: 45 % points (500 are full), 35 % share that stayed,
    20 % plausibility.
    """
    out = spatial.statistical_outliers(points, k, ratio).filter("not outlier").select("scan_id", "point_id")
    kept = settled(points.join(out, ["scan_id", "point_id"]).select("scan_id", "point_id", "x", "y", "z"))
    sizes = points.groupBy("scan_id").agg(F.count("*").alias("n")).join(kept.groupBy("scan_id").agg(F.count("*").alias("points"), F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("z")), "scan_id", "left").fillna(0, ["points"])
    rect = planes.min_area_rectangles(kept, ["scan_id"])
    j = sizes.join(rect, "scan_id", "left").withColumns({"low": F.col("z")[0], "high": F.col("z")[1]})
    floating = (F.col("low") > max(0.60, 0.25 * room_height)) | (F.col("high") > room_height + 0.15)
    degenerate = (F.col("width") < 0.05) | (F.col("high") - F.col("low") < 0.03) | (F.col("length") * F.col("width") < 0.01)
    plausible = ~floating & ~degenerate
    confidence = 0.45 * F.least(F.col("points") / 500, F.lit(1.0)) + 0.35 * F.least(F.col("points") / F.col("n") / 0.7, F.lit(1.0)) + 0.20 * plausible.cast("int")
    reason = F.when(F.col("points") < least, "too_few_points").when(floating, "floating").when(degenerate, "degenerate").when(confidence < 0.35, "low_confidence")
    return j.select("scan_id", "points", "length", "width", "low", "high", confidence.alias("confidence"), F.when(reason.isNull(), "verified").otherwise("rejected").alias("status"), reason.alias("reason"))


def fit_in_boxes(points: DataFrame, boxes: DataFrame, room: DataFrame, margin: float = 0.15, floor: float = 0.06, least: int = 10, reach: float = 0.1) -> DataFrame:
    """(scan_id, box_id, points, cx, cy, sx, sy, low, high): candidate boxes fitted to the points they hold.

    Points within the widened box and above the floor, without those in the
    footprints of earlier (larger) boxes, reduced to their largest component;
    extents along the box's own axes, faces pushed to a wall they end short of.
    """
    own = spatial.points_in_boxes(points.filter(F.col("z") > floor), boxes, (margin, margin, margin), 1.0).join(points.select("scan_id", "point_id", "x", "y", "z"), ["scan_id", "point_id"])
    order = F.struct(-(F.col("sx") * F.col("sy")), "box_id")
    ranked = settled(boxes.select("scan_id", F.col("box_id").alias("object_id"), F.row_number().over(_window(order)).cast("bigint").alias("rank"), "cx", "cy", "sx", "sy", "yaw"))
    own = settled(own.withColumnRenamed("box_id", "object_id"))
    free = tracks.exclude_footprints(own, ranked, 0.10, 50).join(own, ["scan_id", "object_id", "point_id"])
    keyed = settled(free.select(F.col("object_id").alias("scan_id"), F.col("scan_id").alias("room_id"), "point_id", "x", "y", "z"))
    parts = tracks.dense_components(keyed.select("scan_id", "point_id", "x", "y", "z"), reach=reach).select("scan_id", "point_id", F.col("component").alias("cluster"))
    main = parts.join(tracks.largest(parts).select("scan_id", "cluster"), ["scan_id", "cluster"]).select("scan_id", "point_id")
    box = boxes.select(F.col("box_id").alias("scan_id"), "yaw")
    c, s = F.cos("yaw"), F.sin("yaw")
    turned = keyed.join(main, ["scan_id", "point_id"]).join(box, "scan_id").withColumns({"u": c * F.col("x") + s * F.col("y"), "v": c * F.col("y") - s * F.col("x")})
    q = lambda k: F.percentile(k, F.array(F.lit(0.02), F.lit(0.98))).alias(f"q{k}")
    e = turned.groupBy("scan_id", "room_id", "yaw").agg(F.count("*").alias("points"), q("u"), q("v"), q("z")).filter(F.col("points") >= least)
    mid = lambda k: (F.col(f"q{k}")[0] + F.col(f"q{k}")[1]) / 2
    e = e.select(F.col("room_id").alias("scan_id"), F.col("scan_id").alias("box_id"), "yaw", "points", (c * mid("u") - s * mid("v")).alias("cx"), (s * mid("u") + c * mid("v")).alias("cy"), (F.col("qu")[1] - F.col("qu")[0]).alias("sx"), (F.col("qv")[1] - F.col("qv")[0]).alias("sy"), F.col("qz")[0].alias("low"), F.col("qz")[1].alias("high"))
    j = settled(e).join(room, "scan_id")
    snapped = rooms.snap_faces(*(F.col(k) for k in ("cx", "cy", "sx", "sy", "yaw")), {k: F.col(k) for k in ("lo_x", "hi_x", "lo_y", "hi_y")})
    return j.select("scan_id", "box_id", "points", snapped.alias("s"), "low", "high").select("scan_id", "box_id", "points", "s.*", "low", "high")


def _window(order: Column):
    from pyspark.sql import Window

    return Window.partitionBy("scan_id").orderBy(order)
