"""Openings from detections: rays through a frame's corners meet finite walls, and several views agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slack beside, below and above a wall, least distance of a hit, quantiles of the hits, least sizes.
BESIDE, ABOVE, NEAREST, INNER, LEAST_WIDTH, LEAST_HEIGHT = 0.20, 0.15, 0.05, 0.15, 0.30, 0.35


def _directed(pixels: DataFrame) -> DataFrame:
    """``pixels`` (u, v and a camera's columns) with the unit direction (rx, ry, rz) of each ray."""
    local = pixels.withColumns({"lu": (F.col("u") - F.col("ox")) / F.col("fx"), "lv": (F.col("v") - F.col("oy")) / F.col("fy")})
    turned = local.withColumns({f"t{c}": F.col("rotation")[k] * F.col("lu") + F.col("rotation")[3 + k] * F.col("lv") + F.col("rotation")[6 + k] for k, c in enumerate("xyz")})
    sized = turned.withColumn("size", F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2))
    return sized.withColumns({f"r{c}": F.col(f"t{c}") / F.col("size") for c in "xyz"})


def _met(rays: DataFrame) -> DataFrame:
    """``rays`` beside a wall's columns, with distance, along, z and inside; a ray along the wall meets nothing."""
    cos, sin = F.cos("yaw"), F.sin("yaw")
    facing = rays.withColumn("facing", cos * F.col("ry") - sin * F.col("rx"))
    away = F.when(F.abs("facing") > 1e-5, (cos * (F.col("wy") - F.col("py")) - sin * (F.col("wx") - F.col("px"))) / F.col("facing"))
    far = facing.withColumn("distance", away)
    at = far.withColumns({"along": cos * (F.col("px") + F.col("rx") * F.col("distance") - F.col("wx")) + sin * (F.col("py") + F.col("ry") * F.col("distance") - F.col("wy")), "z": F.col("pz") + F.col("rz") * F.col("distance")})
    inside = (F.col("distance") > NEAREST) & (F.abs("along") <= F.col("length") / 2 + BESIDE) & F.col("z").between(F.lit(-ABOVE), F.col("height") + ABOVE)
    return at.withColumn("inside", F.coalesce(inside, F.lit(False)))


def corner_hits(detections: DataFrame, cameras: DataFrame, walls: DataFrame) -> DataFrame:
    """(scan_id, view_id, det_id, kind, wall_id, hits): the wall that a detection belongs to, and where its rays meet it.

    ``detections`` (scan_id, view_id, det_id, kind, x1, y1, x2, y2), ``cameras``
    (scan_id, view_id, fx, fy, ox, oy, rotation world to camera, px, py, pz),
    ``walls`` (scan_id, wall_id, wx, wy, yaw in radians, length, height). Five
    rays a detection: its middle and its corners. A wall counts only if the
    middle ray meets it; the one with most rays wins, then the nearer, then the
    lower number. A room's few walls meet each of its detections.
    """
    c = F.col
    pixels = [((c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2), (c("x1"), c("y1")), (c("x2"), c("y1")), (c("x2"), c("y2")), (c("x1"), c("y2"))]
    cast = detections.select("scan_id", "view_id", "det_id", "kind", F.posexplode(F.array(*(F.struct(u.alias("u"), v.alias("v")) for u, v in pixels))).alias("ray", "p"))
    told = _directed(cast.select("scan_id", "view_id", "det_id", "kind", "ray", "p.*").join(cameras, ["scan_id", "view_id"]))
    met = _met(told.join(walls, "scan_id")).filter("inside")
    keys = ["scan_id", "view_id", "det_id", "kind"]
    each = met.groupBy(*keys, "wall_id").agg(F.sort_array(F.collect_list(F.struct("ray", "along", "z"))).alias("hits"), F.max(F.when(F.col("ray") == 0, F.col("distance"))).alias("d"))
    order = F.struct(F.size("hits").alias("n"), (-F.col("d")).alias("d"), (-F.col("wall_id")).alias("w"))
    best = each.filter("d is not null").groupBy(*keys).agg(F.max_by(F.struct("wall_id", "hits"), order).alias("b"))
    return best.select(*keys, "b.*")


def openings(hits: DataFrame, walls: DataFrame, rooms: DataFrame, known: DataFrame, views: int = 2) -> DataFrame:
    """(scan_id, kind, wall_id, along, cx, cy, bottom, width, height, views) of openings that the layout lacks.

    Per scan and kind the wall that most views agree on (the lower number
    where as many do), if ``views`` or more; the opening spans the 15 % to 85 %
    quantiles of all hits there. Doors reach the floor. ``rooms`` (scan_id,
    room_height), ``known`` (scan_id, kind) has what the layout holds already:
    those kinds are left out. Without detections there are none.
    """
    missing = hits.join(known.select("scan_id", "kind").distinct(), ["scan_id", "kind"], "left_anti")
    quantiles = F.array(F.lit(INNER), F.lit(1 - INNER))
    each = missing.select("scan_id", "kind", "wall_id", "view_id", F.explode("hits").alias("h"))
    merged = each.groupBy("scan_id", "kind", "wall_id").agg(F.countDistinct("view_id").alias("views"), F.percentile("h.along", quantiles).alias("a"), F.percentile("h.z", quantiles).alias("z"))
    best = merged.groupBy("scan_id", "kind").agg(F.max_by(F.struct("wall_id", "views", "a", "z"), F.struct("views", (-F.col("wall_id")).alias("w"))).alias("b")).select("scan_id", "kind", "b.*").filter(F.col("views") >= views)
    j = best.join(walls, ["scan_id", "wall_id"]).join(rooms, "scan_id")
    bottom = F.when(F.col("kind") == "door", 0.0).otherwise(F.col("z")[0])
    between = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), high)
    along = (F.col("a")[0] + F.col("a")[1]) / 2
    return j.select(
        "scan_id", "kind", "wall_id", along.alias("along"), (F.col("wx") + F.cos("yaw") * along).alias("cx"), (F.col("wy") + F.sin("yaw") * along).alias("cy"), bottom.alias("bottom"),
        between(F.col("a")[1] - F.col("a")[0], LEAST_WIDTH, F.col("length")).alias("width"), between(F.col("z")[1] - bottom, LEAST_HEIGHT, F.col("room_height")).alias("height"), "views",
    )
