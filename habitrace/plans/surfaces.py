"""Completed surfaces, and image pairs by homographies."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import completion, matching
from habitrace.plans.define import query
from habitrace.plans.registration import _WALLS
from habitrace.plans.rooms import _P, _metric
from habitrace.sources.driver_tables import room_points

CELL = 0.4

#: A door in the first wall, a window in the second of every scan: wall, kind, place along it, bottom, width, height.
_OPENINGS = [(0, "door", 0.5, 0.0, 0.9, 2.0), (1, "window", -0.4, 0.9, 1.2, 1.0)]


def _scene(spark, sf_dir):
    p = _metric(spark, sf_dir).withColumn("colour", F.col("label"))
    scans = p.select("scan_id").distinct()
    listed = lambda rows, names: scans.select("scan_id", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))).alias("r")).select("scan_id", "r.*")
    sides = listed(_WALLS, ("wall_id", "wx", "wy", "yaw", "length", "height"))
    openings = listed(_OPENINGS, ("wall_id", "kind", "along", "bottom", "width", "height"))
    return p, sides, openings


_SIDES = f"w(wall_id, wx, wy, yaw, len, hgt) as (values {', '.join(f'({a}, {b}::double, {c}::double, {d}::double, {e}::double, {f}::double)' for a, b, c, d, e, f in _WALLS)})"
_CUT = f"o(wall_id, kind, along, bottom, ow, oh) as (values {', '.join(f'''({a}, '{b}', {c}::double, {d}::double, {e}::double, {f}::double)''' for a, b, c, d, e, f in _OPENINGS)})"


@query(
    f"""{_P}, {_SIDES}, {_CUT}, ow as (select distinct p.scan_id, w.wall_id, floor((cos(yaw) * (x - wx) + sin(yaw) * (y - wy) + len / 2) / {CELL}) as ku, floor(z / {CELL}) as kv from p cross join w
  where abs(cos(yaw) * (y - wy) - sin(yaw) * (x - wx)) <= 0.075 and abs(cos(yaw) * (x - wx) + sin(yaw) * (y - wy)) <= len / 2 + 0.05 and z between 0 and hgt),
g as (select scan_id, wall_id, i as ku, j as kv, -len / 2 + (i + 0.5) * {CELL} as u, (j + 0.5) * {CELL} as v from (select distinct scan_id from p), w, (select unnest(range(0, 100)) as i), (select unnest(range(0, 100)) as j) where -len / 2 + (i + 0.5) * {CELL} < len / 2 and (j + 0.5) * {CELL} < hgt),
f as (select e.*, coalesce((select max(case when kind = 'door' then 2 else 1 end) from o where o.wall_id = e.wall_id and abs(u - along) <= ow / 2 + 0.08 and v between bottom - 0.08 and bottom + oh + 0.08), 0) as cut from g e where not exists (select 1 from ow where ow.scan_id = e.scan_id and ow.wall_id = e.wall_id and ow.ku = e.ku and ow.kv = e.kv))
select scan_id, wall_id, count(*) as filled, count(*) filter (cut = 1) as windows from f where cut < 2 group by 1, 2"""
)
def wall_completion(spark, sf_dir):
    """Points made for the empty cells of four walls, a door cut out and a window marked; cells of 0.4 m as the clouds are sparse."""
    made = completion.walls(*_scene(spark, sf_dir), cell=CELL)
    return made.groupBy("scan_id", "wall_id").agg(F.count("*").alias("filled"), F.count_if("window").alias("windows"))


@query(
    f"""{_P}, s as (select scan_id from p where z <= 0.075 group by 1 having count(*) >= 5), ow as (select distinct scan_id, floor((x + 2) / {CELL}) as ku, floor((y + 2) / {CELL}) as kv from p semi join s using (scan_id) where z <= 0.075),
g as (select scan_id, i as ku, j as kv from s, (select unnest(range(0, 10)) as i), (select unnest(range(0, 10)) as j)) select scan_id, count(*) as filled from g where not exists (select 1 from ow where ow.scan_id = g.scan_id and ow.ku = g.ku and ow.kv = g.kv) group by 1"""
)
def floor_completion(spark, sf_dir):
    """Points made for the empty cells of the floors on which five points lie."""
    p, _, _ = _scene(spark, sf_dir)
    rooms = p.select("scan_id").distinct().select("scan_id", *(F.lit(v).alias(c) for c, v in (("lo_x", -2.0), ("hi_x", 2.0), ("lo_y", -2.0), ("hi_y", 2.0))))
    return completion.floors(p, rooms, CELL, 5).groupBy("scan_id").agg(F.count("*").alias("filled"))


def _candidates(spark, sf_dir):
    """Three reference images of every scan: under a homography where a hash of the point allows it (6, 3 and 0 of ten), elsewhere by chance; each keypoint has a second candidate, for every ninth as near as the first."""
    p = room_points(spark, sf_dir)
    key = p.select(F.col("scan_id").alias("query_id"), F.col("point_id").alias("key_id"), (F.col("x") * 500 + 320).alias("x"), (F.col("y") * 500 + 240).alias("y"))
    seen = key.select("*", F.explode(F.sequence(*(F.lit(k).cast("long") for k in (0, 2)))).alias("ref_id"))
    draw = lambda k, n: F.pmod(F.xxhash64("key_id", "ref_id", F.lit(k)), F.lit(n)).cast("double")
    depth = 1 + 0.0004 * F.col("x") - 0.0003 * F.col("y")
    true = draw(1, 10) < 6 - 3 * F.col("ref_id")
    u = F.when(true, (0.9 * F.col("x") + 0.12 * F.col("y") + 15) / depth).otherwise(draw(2, 640))
    v = F.when(true, (-0.1 * F.col("x") + 1.05 * F.col("y") - 8) / depth).otherwise(draw(3, 480))
    two = F.array(*(F.struct(F.lit(i).alias("other_id"), d.alias("distance")) for i, d in ((0, F.lit(20.0)), (1, F.when(F.col("key_id") % 9 == 0, 25.0).otherwise(40.0)))))
    return seen.select("query_id", "ref_id", "key_id", F.explode(two).alias("c"), "x", "y", u.alias("u"), v.alias("v")).select("query_id", "ref_id", "key_id", "c.*", *"xyuv")


@query()
def image_pairs(spark, sf_dir):
    """Matches and inliers of every scan's image with its references."""
    return matching.homographies(matching.good_matches(_candidates(spark, sf_dir))).select("query_id", "ref_id", "matches", "inliers")


@query()
def image_anchors(spark, sf_dir):
    """The reference that each scan's image agrees with best."""
    return matching.anchors(matching.homographies(matching.good_matches(_candidates(spark, sf_dir))))
