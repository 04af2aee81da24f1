"""Routes and passages of rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import grid, routes
from habitrace.plans.define import query, r6
from habitrace.session import settled
from habitrace.sources.driver_tables import room_boxes, room_points


@query()
def door_to_bed_routes(spark, sf_dir):
    """Rooms of twelve boxes, 6 by 6 m: the way from the door to the bed for a person of 45 cm."""
    b = room_boxes(spark, sf_dir).withColumn("scan_id", F.floor(F.col("box_id") / 12))
    place = F.col("box_id") % 12
    item = b.select("scan_id", F.col("box_id").alias("item_id"), F.when(place == 1, "bed").otherwise("table").alias("kind"), F.least(F.greatest("cx", F.lit(-2.6)), F.lit(2.6)).alias("cx"), F.least(F.greatest("cy", F.lit(-2.6)), F.lit(2.6)).alias("cy"), (F.col("sx") * 2).alias("length"), (F.col("sy") * 2).alias("width"), "yaw", place.alias("place"))
    doors = settled(item.filter("place = 0").withColumns({"kind": F.lit("door"), "cy": F.lit(-3.0), "width": F.lit(0.9), "yaw": F.lit(0.0)}))
    rooms = b.select("scan_id").distinct().select("scan_id", *(F.lit(v).alias(c) for c, v in (("lo_x", -3.0), ("hi_x", 3.0), ("lo_y", -3.0), ("hi_y", 3.0))))
    found = routes.routes(settled(rooms), item.filter("place > 0"), doors)
    return found.select("scan_id", "status", "reason", *(r6(c).alias(c) for c in ("path_length", "min_width", "walkable_area")), "can_pass", "passage", "cells")


@query()
def passage_analysis(spark, sf_dir):
    """The passage across each scan's floor between its lowest and its highest point, from occupancy alone."""
    p = room_points(spark, sf_dir)
    cells = grid.cells(p, 0.05, F.col("label") < 2, border=2)
    at = lambda c: (F.floor(F.col(f"k.{c}") / 0.05)).cast("int")
    end = lambda f, k: p.groupBy("scan_id").agg(f(F.struct("y", "x")).alias("k")).select("scan_id", at("y").alias(f"row{k}"), at("x").alias(f"col{k}"))
    ends = settled(end(F.min, 0).join(end(F.max, 1), "scan_id"))
    return routes.passages(cells, ends, 0.05).withColumns({c: r6(c) for c in ("passage_width", "path_width")})
