"""The semantic space: measured objects, their relations, and both in another unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import space, spatial
from habitrace.plans.define import query, r6
from habitrace.plans.rooms import _metric
from habitrace.sources.driver_tables import ROOM_BOXES_SQL, room_boxes


def _objects(spark, sf_dir):
    """(points, frames) of instances: the points of a scan whose label is below 5, and the others; every frame is turned by 30 degrees."""
    p = _metric(spark, sf_dir).withColumn("instance_id", F.col("scan_id") * 2 + (F.col("label") < 5).cast("long"))
    c, s = F.cos(F.pi() / 6), F.sin(F.pi() / 6)
    zero = F.lit(0.0)
    floor = p.groupBy("instance_id").agg(F.percentile("z", 0.01).alias("floor"))
    axes = F.array(c, s, zero, -s, c, zero, zero, zero, F.lit(1.0))
    return p, floor.select("instance_id", F.array(zero, zero, "floor").alias("origin"), axes.alias("axes"))


def _measured(spark, sf_dir):
    p, frames = _objects(spark, sf_dir)
    near = spatial.nearest(p.select("scan_id", "point_id", *"xyz"), p.select("scan_id", "point_id", *"xyz"), 3, 0.5).groupBy("scan_id", "a").agg(F.max("d").alias("d")).groupBy("scan_id").agg(F.percentile("d", 0.25).alias("scene_spacing"))
    scene = p.select("scan_id", "instance_id").distinct().join(near, "scan_id").select("instance_id", "scene_spacing")
    return space.measured(p, frames, scene)


@query()
def measured_objects(spark, sf_dir):
    """Every instance with its geometry, or the reason why it has none."""
    m = _measured(spark, sf_dir)
    return m.select("instance_id", "status", "reason", "points", "cleaned", "clusters", "confidence", *(r6(c).alias(c) for c in ("retained", "stability", "area", *space.LENGTHS)))


@query()
def rescaled_objects(spark, sf_dir):
    """The same objects with all lengths times 1.25: one record is rescaled as a whole."""
    m = space.rescaled(_measured(spark, sf_dir), 1.25)
    return m.select("instance_id", "status", *(r6(c).alias(c) for c in ("stability", "area", *space.LENGTHS)), r6(F.col("center")[0]).alias("x"), r6(F.col("corners")[7][2]).alias("top"))


_CORNER = "cx + (cos(yaw) * {a} * sx - sin(yaw) * {b} * sy) / 2 as x{i}, cy + (sin(yaw) * {a} * sx + cos(yaw) * {b} * sy) / 2 as y{i}"
_TURNS = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
_GAP = "least(" + ", ".join(f"sqrt(pow(l.x{i} - r.x{j}, 2) + pow(l.y{i} - r.y{j}, 2))" for i in range(4) for j in range(4)) + ")"


@query(
    f"""with {ROOM_BOXES_SQL}, o as (select scan_id, box_id, cx, cy, cz, {', '.join(_CORNER.format(a=a, b=b, i=i) for i, (a, b) in enumerate(_TURNS))} from boxes),
d as (select l.scan_id, l.box_id as instance_id, r.box_id as other_id, sqrt((l.cx - r.cx) * (l.cx - r.cx) + (l.cy - r.cy) * (l.cy - r.cy) + (l.cz - r.cz) * (l.cz - r.cz)) as d, {_GAP} as gap from o l join o r on l.scan_id = r.scan_id and l.box_id <> r.box_id),
k as (select *, row_number() over (partition by scan_id, instance_id order by d, other_id) as rank from d) select scan_id, instance_id, rank::int as rank, other_id, round(d, 4) as center_distance, round(gap, 4) as footprint_gap from k where rank <= 2"""
)
def semantic_relations(spark, sf_dir):
    """The two nearest objects of each, with the gap of their footprints."""
    c, s, hx, hy, zero = F.cos("yaw"), F.sin("yaw"), F.col("sx") / 2, F.col("sy") / 2, F.lit(0.0)
    foot = F.array(*(F.array(F.col("cx") + c * (a * hx) - s * (b * hy), F.col("cy") + s * (a * hx) + c * (b * hy), zero) for a, b in _TURNS))
    o = room_boxes(spark, sf_dir).select("scan_id", F.col("box_id").alias("instance_id"), F.array("cx", "cy", "cz").alias("center"), foot.alias("footprint"))
    return space.relations(o)
