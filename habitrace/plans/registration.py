"""Frames moved to a base, openings from rays, boxes fitted to their views.

The cameras of these queries look from the middle of a room, 1.3 m high, in
eight directions: view k turns by k x 45 degrees.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import box_fit, rays, register
from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import ROOM_BOXES_SQL, points, room_boxes, room_points


def _frames(spark, sf_dir, clouds=points):
    """Four frames a scan, each turned and pushed by a planted motion; the last one far off."""
    p = clouds(spark, sf_dir)
    k = F.col("point_id") % 4
    turn, push = 0.02 * (k + 1), F.when(k == 3, 0.9).otherwise(0.008 * (k - 1))
    c, s = F.cos(turn), F.sin(turn)
    return p.select("scan_id", (F.col("scan_id") * 4 + k).alias("frame_id"), "point_id", (c * F.col("x") - s * F.col("y") + push).alias("x"), (s * F.col("x") + c * F.col("y") - push / 2).alias("y"), (F.col("z") + push / 2).alias("z"))


#: The clouds are a tenth of a room: radius and gates go with them.
GATES = {"radius": 0.05, "near": 0.05, "voxel": None, "least": 10, "rmse": 0.01}


@query()
def frame_registration(spark, sf_dir):
    """Every frame registered to its scan; rejected frames keep their figures and the gate that they fail."""
    found = register.register(_frames(spark, sf_dir, room_points), room_points(spark, sf_dir), **GATES)
    return found.select("scan_id", "frame_id", "points", *(r6(c).alias(c) for c in ("overlap", "fitness", "rmse")), *(r6(F.col("shift")[i]).alias(f"t{i}") for i in range(3)), "accepted", "reason")


def _cameras(spark, sf_dir):
    """(scan_id, view_id, ...): eight views of every scan of boxes."""
    scans = room_boxes(spark, sf_dir).select("scan_id").distinct()
    views = scans.select("scan_id", F.explode(F.sequence(*(F.lit(k).cast("long") for k in (0, 7)))).alias("view_id"))
    a = F.col("view_id") * (F.pi() / 4)
    zero = F.lit(0.0)
    turn = F.array(F.sin(a), -F.cos(a), zero, zero, zero, F.lit(-1.0), F.cos(a), F.sin(a), zero)
    fixed = {"fx": 500.0, "fy": 500.0, "ox": 320.0, "oy": 240.0, "px": 0.0, "py": 0.0, "pz": 1.3, "width": 640.0, "height": 480.0}
    return views.select("scan_id", "view_id", turn.alias("rotation"), *(F.lit(v).alias(k) for k, v in fixed.items()))


_CAMS = "cam as (select scan_id, v as view_id, sin(v * pi() / 4) as sa, cos(v * pi() / 4) as ca from (select distinct scan_id from boxes), (select unnest(range(0, 8)) as v))"

#: Four walls of 4 m around the room: number, middle, turn, length, height.
_WALLS = [(0, 0.0, -2.0, 0.0, 4.0, 2.6), (1, 2.0, 0.0, 1.5707963267948966, 4.0, 2.6), (2, 0.0, 2.0, 0.0, 4.0, 2.6), (3, -2.0, 0.0, 1.5707963267948966, 4.0, 2.6)]


def _room(spark, sf_dir):
    """(walls, detections) of every scan: a box is seen as a door or a window by view box_id % 8, around a pixel that its centre gives."""
    b = room_boxes(spark, sf_dir)
    walls = b.select("scan_id").distinct().select("scan_id", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("wall_id", "wx", "wy", "yaw", "length", "height"), w))) for w in _WALLS))).alias("w")).select("scan_id", "w.*")
    u, v = 320 + F.col("cx") * 60, 240 + F.col("cy") * 40
    det = b.select("scan_id", (F.col("box_id") % 8).alias("view_id"), F.col("box_id").alias("det_id"), F.when(F.col("label") % 2 == 0, "door").otherwise("window").alias("kind"), (u - F.col("sx") * 400).alias("x1"), (v - F.col("sy") * 400).alias("y1"), (u + F.col("sx") * 400).alias("x2"), (v + F.col("sy") * 400).alias("y2"))
    return walls, det


_RAYS = f"""{_CAMS}, w(wall_id, wx, wy, yaw, len, hgt) as (values {', '.join(f'({a}, {b}::double, {c}::double, {d}::double, {e}::double, {f}::double)' for a, b, c, d, e, f in _WALLS)}),
d as (select scan_id, box_id % 8 as view_id, box_id as det_id, case when label % 2 = 0 then 'door' else 'window' end as kind, 320 + cx * 60 as u, 240 + cy * 40 as v, sx * 400 as du, sy * 400 as dv from boxes),
px as (select d.*, k, u + a * du as pu, v + b * dv as pv from d, (values (0, 0, 0), (1, -1, -1), (2, 1, -1), (3, 1, 1), (4, -1, 1)) o(k, a, b)),
ry as (select px.*, ((pu - 320) / 500) * sa + ca as rx, -((pu - 320) / 500) * ca + sa as ry, -((pv - 240) / 500) as rz from px join cam using (scan_id, view_id)),
un as (select * exclude (rx, ry, rz), rx / n as rx, ry / n as ry, rz / n as rz from (select *, sqrt(rx * rx + ry * ry + rz * rz) as n from ry)),
hw as (select un.*, w.*, case when abs(cos(yaw) * ry - sin(yaw) * rx) > 1e-5 then (cos(yaw) * wy - sin(yaw) * wx) / (cos(yaw) * ry - sin(yaw) * rx) end as t from un cross join w),
hi as (select *, cos(yaw) * (rx * t - wx) + sin(yaw) * (ry * t - wy) as along, 1.3 + rz * t as z from hw),
ins as (select *, coalesce(t > 0.05 and abs(along) <= len / 2 + 0.2 and z between -0.15 and hgt + 0.15, false) as inside from hi),
sc as (select scan_id, view_id, det_id, kind, wall_id, count(*) filter (inside) as n, max(t) filter (k = 0) as t0 from ins group by all having bool_or(inside) filter (k = 0)),
be as (select *, row_number() over (partition by det_id order by n desc, t0, wall_id) as r from sc),
ht as (select i.* from ins i join be on be.r = 1 and be.det_id = i.det_id and be.wall_id = i.wall_id where inside)"""


@query(f"with {ROOM_BOXES_SQL}, {_RAYS} select scan_id, view_id, det_id, kind, wall_id, count(*)::int as rays, {q6('avg(along)')} as along, {q6('avg(z)')} as z from ht group by all")
def corner_ray_hits(spark, sf_dir):
    """The wall of each detection, how many of its five rays meet it and where."""
    walls, det = _room(spark, sf_dir)
    hits = rays.corner_hits(det, _cameras(spark, sf_dir).drop("height", "width"), walls)
    mean = lambda f: r6(F.aggregate("hits", F.lit(0.0), lambda s, h: s + h[f]) / F.size("hits"))
    return hits.select("scan_id", "view_id", "det_id", "kind", "wall_id", F.size("hits").alias("rays"), mean("along").alias("along"), mean("z").alias("z"))


@query(
    f"""with {ROOM_BOXES_SQL}, {_RAYS}, mg as (select scan_id, kind, wall_id, count(distinct view_id) as views, quantile_cont(along, 0.15) as a0, quantile_cont(along, 0.85) as a1, quantile_cont(z, 0.15) as z0, quantile_cont(z, 0.85) as z1 from ht where not (kind = 'door' and scan_id % 3 = 0) group by 1, 2, 3),
bw as (select *, row_number() over (partition by scan_id, kind order by views desc, wall_id) as r from mg), fl as (select *, case when kind = 'door' then 0 else z0 end as bottom, (a0 + a1) / 2 as mid from bw join w using (wall_id) where r = 1 and views >= 2)
select scan_id, kind, wall_id, {q6('mid')} as along, {q6('wx + cos(yaw) * mid')} as cx, {q6('wy + sin(yaw) * mid')} as cy, {q6('bottom')} as bottom, {q6('least(greatest(a1 - a0, 0.3), len)')} as width, {q6('least(greatest(z1 - bottom, 0.35), 2.6)')} as height, views from fl"""
)
def corner_ray_openings(spark, sf_dir):
    """Openings that at least two views' corner rays agree on; every third scan has its door already."""
    walls, det = _room(spark, sf_dir)
    hits = rays.corner_hits(det, _cameras(spark, sf_dir).drop("height", "width"), walls)
    scans = walls.select("scan_id").distinct()
    found = rays.openings(hits, walls, scans.select("scan_id", F.lit(2.6).alias("room_height")), scans.filter("scan_id % 3 = 0").select("scan_id", F.lit("door").alias("kind")))
    return found.select("scan_id", "kind", "wall_id", *(r6(c).alias(c) for c in ("along", "cx", "cy", "bottom", "width", "height")), "views")


def _tracks(spark, sf_dir):
    """(boxes, detections): each box stands on its scan's floor, 2.5 m from the middle or more, and is seen in all eight views."""
    b = room_boxes(spark, sf_dir)
    far = F.greatest(F.hypot("cx", "cy"), F.lit(0.01))
    place = {c: F.col(c) / far * (2.5 + F.abs("cz")) for c in ("cx", "cy")}
    turn = F.col("yaw") * (90 / F.pi())
    placed = b.select(F.col("box_id").alias("track_id"), "scan_id", *(v.alias(k) for k, v in place.items()), turn.alias("yaw"), *((F.col(c) * 3 + 0.3).alias(c) for c in ("sx", "sy", "sz")))
    seen = placed.select("track_id", F.explode(F.sequence(*(F.lit(k).cast("long") for k in (0, 7)))).alias("view_id"))
    return placed, seen


_PLACED = "pl as (select box_id as track_id, scan_id, cx / greatest(sqrt(cx * cx + cy * cy), 0.01) * (2.5 + abs(cz)) as cx, cy / greatest(sqrt(cx * cx + cy * cy), 0.01) * (2.5 + abs(cz)) as cy, yaw / 2 as yaw, sx * 3 + 0.3 as sx, sy * 3 + 0.3 as sy, sz * 3 + 0.3 as sz from boxes)"
_CORNERS = """co as (select pl.track_id, cam.view_id, cam.sa, cam.ca, cx + cos(yaw) * a * sx - sin(yaw) * b * sy as x, cy + sin(yaw) * a * sx + cos(yaw) * b * sy as y, sz / 2 + c * sz - 1.3 as z from pl join cam using (scan_id), (values (-0.5), (0.5)) p(a), (values (-0.5), (0.5)) q(b), (values (-0.5), (0.5)) r(c)),
uv as (select track_id, view_id, 500 * (sa * x - ca * y) / (ca * x + sa * y) + 320 as u, 500 * -z / (ca * x + sa * y) + 240 as v from co where ca * x + sa * y > 0.05),
bx as (select track_id, view_id, min(u) as u0, min(v) as v0, max(u) as u1, max(v) as v1 from uv group by 1, 2 having count(*) >= 4)"""
_DETECTED = "dt as (select track_id, view_id, least(greatest(320 + (view_id - 3) * 20 - 60, 0), 640) as x1, 150 + view_id * 10 as y1, least(320 + (view_id - 3) * 60 + track_id % 300, 640) as x2, least(300 + track_id % 200, 480) as y2 from pl, (select unnest(range(0, 8)) as view_id))"


@query(
    f"""with {ROOM_BOXES_SQL}, {_CAMS}, {_PLACED}, {_CORNERS}, {_DETECTED}, fr as (select dt.*, u0, v0, u1, v1, x1 > 2 as f0, y1 > 2 as f1, x2 < 637 as f2, y2 < 477 as f3 from dt left join bx using (track_id, view_id)), al as (select *, not (f0 or f1 or f2 or f3) as clipped from fr)
select track_id, view_id, {q6('u0')} as u0, {q6('v0')} as v0, {q6('u1')} as u1, {q6('v1')} as v1,
{q6('case when f0 then coalesce((u0 - x1) / 640, 3) when clipped then coalesce((u0 + u1 - x1 - x2) / 1280, 3) end')} as r0, {q6('case when f1 then coalesce((v0 - y1) / 640, 3) when clipped then coalesce((v0 + v1 - y1 - y2) / 1280, 3) end')} as r1,
{q6('case when f2 then coalesce((u1 - x2) / 640, 3) end')} as r2, {q6('case when f3 then coalesce((v1 - y2) / 640, 3) end')} as r3 from al"""
)
def box_reprojection(spark, sf_dir):
    """Eight corners of each box in each view, and the residuals of the edges that the image's border doesn't censor."""
    placed, seen = _tracks(spark, sf_dir)
    v, t = F.col("view_id"), F.col("track_id")
    found = seen.select("track_id", "view_id", F.least(F.greatest(320 + (v - 3) * 20 - 60, F.lit(0)), F.lit(640)).alias("x1"), (150 + v * 10).alias("y1"), F.least(320 + (v - 3) * 60 + t % 300, F.lit(640)).alias("x2"), F.least(300 + t % 200, F.lit(480)).alias("y2"))
    made = box_fit.reprojection(placed, _cameras(spark, sf_dir), found)
    return made.select("track_id", "view_id", *(r6(c).alias(c) for c in ("u0", "v0", "u1", "v1", "r0", "r1", "r2", "r3")))


@query()
def multiview_box_fit(spark, sf_dir):
    """Boxes found again from what their views detect, from an anchor 0.1 off; views that don't see a box have no detection."""
    placed, seen = _tracks(spark, sf_dir)
    none = seen.select("track_id", "view_id", *(F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")))
    shown = box_fit.reprojection(placed, _cameras(spark, sf_dir), none).filter("u0 < 640 and u1 > 0 and v0 < 480 and v1 > 0")
    clip = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(most))
    found = shown.select("track_id", "view_id", clip("u0", 640.0).alias("x1"), clip("v0", 480.0).alias("y1"), clip("u1", 640.0).alias("x2"), clip("v1", 480.0).alias("y2"))
    tracks = placed.select("track_id", "scan_id", (F.col("cx") + 0.1).alias("ax"), (F.col("cy") - 0.05).alias("ay"), "sx", "sy", "sz", "yaw", *(F.lit(v).alias(c) for c, v in (("lo_x", -9.0), ("lo_y", -9.0), ("hi_x", 9.0), ("hi_y", 9.0))))
    fit = box_fit.fit_boxes(tracks, found, _cameras(spark, sf_dir))
    return fit.select("track_id", "status", "views", *(F.round(c, 3).alias(c) for c in ("score", "cx", "cy", "height")))
