"""Rooms: alignment, walls, openings, snapping, placing, distances, passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import layout as boxes_ops
from habitrace.operators import rooms
from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import BOXES_SQL, POINTS_SQL, ROOM_BOXES_SQL, ROOM_POINTS_SQL, boxes, points, room_boxes, room_points

#: Points in metres (tenfold) and the rooms they bound.
_TENFOLD = "p as (select scan_id, point_id, label, x * 10 as x, y * 10 as y, z * 10 + 1 as z from points)"
_P = f"with {ROOM_POINTS_SQL}, {_TENFOLD}"
_R = "room as (select scan_id, quantile_cont(x, 0.01) as lo_x, quantile_cont(x, 0.99) as hi_x, quantile_cont(y, 0.01) as lo_y, quantile_cont(y, 0.99) as hi_y, least(greatest(quantile_cont(z, 0.99) - greatest(quantile_cont(z, 0.01), 0), 1.8), 4.5) as height from p group by 1)"


def _metric(spark, sf_dir, clouds=room_points):
    axis = lambda c, k=0.0: (F.col(c) * 10 + k).alias(c)
    return clouds(spark, sf_dir).select("scan_id", "point_id", "label", axis("x"), axis("y"), axis("z", 1.0))


_D = "d as (select scan_id, avg(x) as dx, avg(y) as dy, avg(z) + 0.05 as dz from points group by 1), u as (select scan_id, dx / (sqrt(dx*dx+dy*dy+dz*dz) + 1e-12) as x, dy / (sqrt(dx*dx+dy*dy+dz*dz) + 1e-12) as y, dz / (sqrt(dx*dx+dy*dy+dz*dz) + 1e-12) as c from d), k as (select *, (1 - c) / (x*x + y*y + 1e-12) as k from u)"
_ROT = [["1 - k*x*x", "-k*x*y", "-x"], ["-k*x*y", "1 - k*y*y", "-y"], ["x", "y", "1 - k*(x*x + y*y)"]]


@query(f"with {ROOM_POINTS_SQL}, {_D} select scan_id, " + ", ".join(f"{q6(_ROT[i][j])} as r{i}{j}" for i in range(3) for j in range(3)) + " from k")
def rotation_to_up(spark, sf_dir):
    """The least rotation that turns each scan's up direction to +z."""
    d = room_points(spark, sf_dir).groupBy("scan_id").agg(F.avg("x").alias("dx"), F.avg("y").alias("dy"), (F.avg("z") + 0.05).alias("dz"))
    rows = rooms.rotation_to_z(F.col("dx"), F.col("dy"), F.col("dz"))
    return d.select("scan_id", *(r6(rows[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)))


_TURNED = [" + ".join(f"({r.replace('x', 'k.x').replace('y', 'k.y').replace('k*', 'k.k*')}) * p.{c}" for r, c in zip(row, "xyz")) for row in _ROT]


@query(f"with {ROOM_POINTS_SQL}, {_D}, f as (select scan_id, quantile_cont(z, 0.01) as floor from points group by 1) select p.scan_id, p.point_id, {q6(f'({_TURNED[0]}) * 1.37')} as x, {q6(f'({_TURNED[1]}) * 1.37')} as y, {q6(f'({_TURNED[2]} - f.floor) * 1.37')} as z from points p join k using (scan_id) join f using (scan_id)")
def rigid_alignment(spark, sf_dir):
    """Points turned to +z, put on the floor and scaled."""
    p = room_points(spark, sf_dir)
    d = p.groupBy("scan_id").agg(F.avg("x").alias("dx"), F.avg("y").alias("dy"), (F.avg("z") + 0.05).alias("dz"), F.percentile("z", 0.01).alias("floor"))
    aligned = rooms.rigid_align(rooms.rotation_to_z(F.col("dx"), F.col("dy"), F.col("dz")), F.col("floor"), F.lit(1.37))
    return p.join(d, "scan_id").select("scan_id", "point_id", *(r6(c).alias(n) for c, n in zip(aligned, "xyz")))


@query(
    f"""{_P}, {_R} select scan_id, w.id as wall_id, {q6("case w.id when 1 then hi_x when 3 then lo_x else (lo_x + hi_x) / 2 end")} as cx, {q6("case w.id when 0 then lo_y when 2 then hi_y else (lo_y + hi_y) / 2 end")} as cy, {q6("height / 2")} as cz,
{q6("case when w.id % 2 = 0 then hi_x - lo_x else hi_y - lo_y end")} as length, {q6("height")} as height, case when w.id % 2 = 0 then 0.0 else 90.0 end::double as rotation from room, (values (0), (1), (2), (3)) w(id)"""
)
def room_walls(spark, sf_dir):
    """The four walls of each room's bounds."""
    w = rooms.walls(rooms.bounds(_metric(spark, sf_dir)))
    return w.select("scan_id", "wall_id", *(r6(c).alias(c) for c in ("cx", "cy", "cz", "length", "height")), "rotation")


_O = "o as (select scan_id, box_id as opening_id, case when label = 0 then 'door' else 'window' end as kind, cx, cy, cz + 1 as cz, sx * 2 as width, sz * 3 as height, case when box_id % 2 = 0 then box_id % 4 end as preferred from boxes where label in (0, 1))"


def _openings(spark, sf_dir, found=room_boxes):
    b = found(spark, sf_dir).filter("label in (0, 1)")
    return b.select("scan_id", F.col("box_id").alias("opening_id"), F.when(F.col("label") == 0, "door").otherwise("window").alias("kind"), "cx", "cy", (F.col("cz") + 1).alias("cz"), (F.col("sx") * 2).alias("width"), (F.col("sz") * 3).alias("height"), F.when(F.col("box_id") % 2 == 0, F.col("box_id") % 4).alias("preferred"))


@query(f"with {POINTS_SQL}, {_TENFOLD}, {BOXES_SQL}, {_O} select p.scan_id, p.point_id, o.opening_id from p join o using (scan_id) where case when opening_id % 4 in (1, 3) then abs(p.y - o.cy) else abs(p.x - o.cx) end <= width / 2 + 0.08 and p.z between o.cz - height / 2 - 0.08 and o.cz + height / 2 + 0.08")
def points_in_openings(spark, sf_dir):
    """Points within an opening of its wall; they meet by cells of a metre along the wall and in height."""
    p = _metric(spark, sf_dir, points).select("scan_id", "point_id", "x", "y", "z", F.floor("z").alias("g"), F.posexplode(F.array(F.floor("x"), F.floor("y"))).alias("axis", "h")).alias("p")
    o = _openings(spark, sf_dir, boxes).withColumn("wall_id", F.col("opening_id") % 4)
    along_y = F.col("wall_id").isin(1, 3)
    touched = lambda at, size: F.explode(F.sequence(F.floor(at - size / 2 - 0.0800001), F.floor(at + size / 2 + 0.0800001)))
    o = o.withColumns({"axis": along_y.cast("int"), "g": touched(F.col("cz"), F.col("height"))}).withColumn("h", touched(F.when(along_y, F.col("cy")).otherwise(F.col("cx")), F.col("width"))).alias("o")
    of = lambda s, cols: {c: F.col(f"{s}.{c}") for c in cols}
    met = p.join(o, [F.col(f"p.{c}") == F.col(f"o.{c}") for c in ("scan_id", "axis", "g", "h")])
    return met.filter(rooms.inside_opening(of("p", "xyz"), of("o", ("wall_id", "cx", "cy", "cz", "width", "height")))).select("p.scan_id", "p.point_id", "o.opening_id")


_EV = f"""{_P}, {_R}, {ROOM_BOXES_SQL}, {_O}, w(wall_id) as (values (0), (1), (2), (3)),
np as (select p.scan_id, w.wall_id, case when w.wall_id in (1, 3) then p.y else p.x end as along, p.z from p join room using (scan_id) cross join w where abs(case w.wall_id when 0 then p.y - lo_y when 1 then p.x - hi_x when 2 then p.y - hi_y else p.x - lo_x end) < 0.12),
e as (select scan_id, opening_id, kind, width, wall_id, case when wall_id in (1, 3) then cy else cx end as middle, case when kind = 'door' then 0.03 else greatest(0.35, cz - height / 2) end as z0, case when kind = 'door' then least(height, 2.4) else cz + height / 2 end as z1 from {{o}} cross join w),
t as (select *, least(z1 + 0.2, 3.2) as top, least(z1 + 0.45, 3.2) as ab from e),
n as (select t.scan_id, t.opening_id, t.wall_id, any_value(kind) as kind, any_value(width) as width, any_value(z0) as z0, any_value(z1) as z1, any_value(top) as top, any_value(ab) as ab,
 count(*) filter (where abs(along - middle) <= width / 2 and z between z0 and z1) as ni, count(*) filter (where abs(along - middle) <= width / 2 + 0.28 and not (abs(along - middle) <= width / 2 and z between z0 and z1) and z >= 0.03 and z <= top) as na,
 count(*) filter (where abs(along - middle) <= width / 2 and z >= 0.03 and z < greatest(z0 - 0.05, 0.04)) as nb, count(*) filter (where abs(along - middle) <= width / 2 and z > z1 + 0.05 and z <= ab) as nt from t left join np on np.scan_id = t.scan_id and np.wall_id = t.wall_id group by 1, 2, 3),
a as (select *, greatest(width * greatest(z1 - z0, 0.2), 0.05) as own from n),
dn as (select *, ni / own as di, na / greatest((width + 0.56) * top - own, 0.05) as da, nb / greatest(width * greatest(z0 - 0.08, 0.05), 0.05) as db, nt / greatest(width * greatest(ab - z1 - 0.05, 0.05), 0.05) as dt from a),
ev as (select scan_id, opening_id, wall_id, ni, da as surround, da / (di + 20.0) * case when kind = 'door' then 1 / (1 + db / 40.0) else least(greatest(least(db, dt) / 80.0, 0), 1) end as evidence from dn)"""


@query(_EV.format(o="o") + f" select scan_id, opening_id, wall_id, {q6('evidence')} as evidence, {q6('surround')} as surround, ni as opening_points from ev")
def opening_evidence(spark, sf_dir):
    """How open each wall of a room looks where an opening is proposed."""
    p = _metric(spark, sf_dir)
    found = rooms.opening_evidence(p, _openings(spark, sf_dir), rooms.bounds(p))
    return found.select("scan_id", "opening_id", "wall_id", r6("evidence").alias("evidence"), r6("surround").alias("surround"), "opening_points")


_CLIPPED = "oc as (select o.scan_id, opening_id, kind, cx, cy, cz, least(greatest(width, 0.35), 2.5) as width, least(greatest(o.height, 0.35), room.height) as height, preferred from o join room using (scan_id))"


@query(
    _EV.format(o="oc").replace("w(wall_id) as", _CLIPPED + ", w(wall_id) as", 1)
    + f""", b as (select *, row_number() over (partition by scan_id, opening_id order by evidence desc, wall_id) as r from ev),
s as (select oc.*, b.wall_id, b.evidence, b.surround, r.lo_x, r.hi_x, r.lo_y, r.hi_y, r.height as room, case preferred when 0 then abs(cy - lo_y) when 1 then abs(cx - hi_x) when 2 then abs(cy - hi_y) when 3 then abs(cx - lo_x) end as away from oc join room r using (scan_id) join b using (scan_id, opening_id) where case when kind = 'window' and preferred is not null then b.wall_id = preferred else b.r = 1 end),
z as (select *, least(greatest(cz, height / 2), room - height / 2) as nz from s)
select scan_id, opening_id, kind, wall_id, {q6("case wall_id when 1 then hi_x when 3 then lo_x else least(greatest(cx, lo_x + width / 2), hi_x - width / 2) end")} as cx, {q6("case wall_id when 0 then lo_y when 2 then hi_y else least(greatest(cy, lo_y + width / 2), hi_y - width / 2) end")} as cy, {q6("nz")} as cz,
case when surround >= 30 and evidence >= 1.75 then 'verified' when kind = 'window' and coalesce(away <= 0.45, false) and width between 0.45 and 2.5 and height between 0.45 and 2.0 and nz - height / 2 >= 0.35 and nz + height / 2 <= room + 0.15 and surround >= 10 or kind = 'door' and coalesce(away <= 0.45, false) and width between 0.5 and 1.25 and height between 1.5 and least(room, 2.4) then 'semantic_supported' else 'rejected' end as status from z"""
)
def opening_snap(spark, sf_dir):
    """Openings on their walls, with the ladder of acceptance."""
    p = _metric(spark, sf_dir)
    room = rooms.bounds(p)
    o = _openings(spark, sf_dir).join(room.select("scan_id", F.col("height").alias("room")), "scan_id")
    o = o.withColumns({"width": rooms.clip(F.col("width"), 0.35, 2.5), "height": rooms.clip(F.col("height"), F.lit(0.35), F.col("room"))}).drop("room")
    found = rooms.snap_openings(o, room, rooms.opening_evidence(p, o, room))
    return found.select("scan_id", "opening_id", "kind", "wall_id", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("cz").alias("cz"), "status")


def _face_steps() -> str:
    """The sixteen tries of face and wall as a chain of tables."""
    faces = [(0, "cos(yaw)", "sin(yaw)"), (0, "-cos(yaw)", "-sin(yaw)"), (1, "-sin(yaw)", "cos(yaw)"), (1, "sin(yaw)", "-cos(yaw)")]
    chain, last = [], "s0"
    for k, ((axis, nx, ny), wall) in enumerate(((f, w) for f in faces for w in range(4)), 1):
        size, (n, c), side = ("sx", "sy")[axis], ((nx, "cx") if wall < 2 else (ny, "cy")), ("1.0", "-1.0")[wall % 2]
        place = ("lo_x", "hi_x", "lo_y", "hi_y")[wall]
        t, g = f"(-({n}) * {side})", f"(({c} + ({n}) * {size} / 2 - {place}) * {side})"
        hit = f"{t} >= 0.7 and {g} > 0 and {g} <= 0.12"
        shift = f"least({g}, 0.2 * {size} + 1e-6)"
        move = {a: f"{c} - case when {hit} then {shift} * {side} / 2 else 0 end" if a == c else a for a in ("cx", "cy")}
        grow = {a: f"{size} + case when {hit} then {shift} * {t} else 0 end" if a == size else a for a in ("sx", "sy")}
        chain.append(f"s{k} as (select scan_id, box_id, yaw, lo_x, hi_x, lo_y, hi_y, {', '.join(f'{v} as {a}' for a, v in (move | grow).items())} from {last})")
        last = f"s{k}"
    return ", ".join(chain) + f" select scan_id, box_id, {', '.join(f'{q6(a)} as {a}' for a in ('cx', 'cy', 'sx', 'sy'))} from {last}"


@query(f"{_P}, {_R}, {ROOM_BOXES_SQL}, s0 as (select b.scan_id, b.box_id, b.yaw / 4 as yaw, b.cx, b.cy, b.sx, b.sy, lo_x, hi_x, lo_y, hi_y from boxes b join room using (scan_id)), {_face_steps()}")
def face_snap(spark, sf_dir):
    """Boxes whose face ends just short of a wall get the missing part."""
    room = rooms.bounds(_metric(spark, sf_dir)).drop("height")
    b = room_boxes(spark, sf_dir).select("scan_id", "box_id", (F.col("yaw") / 4).alias("yaw"), "cx", "cy", "sx", "sy").join(room, "scan_id")
    s = rooms.snap_faces(*(F.col(c) for c in ("cx", "cy", "sx", "sy", "yaw")), {c: F.col(c) for c in ("lo_x", "hi_x", "lo_y", "hi_y")})
    return b.select("scan_id", "box_id", s.alias("s")).select("scan_id", "box_id", *(r6(f"s.{c}").alias(c) for c in ("cx", "cy", "sx", "sy")))


@query(
    f"""{_P}, {_R}, r as (select p.scan_id, label, avg(x) as cx, avg(y) as cy, any_value(lo_x) + 2.2 as lo_x, any_value(hi_x) as hi_x, any_value(lo_y) as lo_y, any_value(hi_y) as hi_y, degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) as yaw, max(x) - min(x) as length, max(y) - min(y) as width from p join room using (scan_id) group by 1, 2),
a as (select *, abs((((yaw + 90) % 180) + 180) % 180 - 90) as a0, abs((((yaw) % 180) + 180) % 180 - 90) as a90 from r), s as (select *, least(cx - lo_x, hi_x - cx, cy - lo_y, hi_y - cy) <= 0.25 and least(a0, a90) <= 8 as snapped, a90 < a0 as across from a),
e as (select s.scan_id, s.label, min(case when across then -p.y else p.x end) as u0, max(case when across then -p.y else p.x end) as u1, min(case when across then p.x else p.y end) as v0, max(case when across then p.x else p.y end) as v1 from s join p on p.scan_id = s.scan_id and p.label = s.label where snapped group by 1, 2)
select s.scan_id, s.label, snapped, {q6("case when snapped then case when across then -90 else 0 end else yaw end")} as yaw, {q6("case when snapped then case when across then (v0 + v1) / 2 else (u0 + u1) / 2 end else cx end")} as cx, {q6("case when snapped then u1 - u0 else length end")} as length from s left join e on e.scan_id = s.scan_id and e.label = s.label"""
)
def yaw_snap(spark, sf_dir):
    """Instances near a wall and nearly in line with it are turned into line and measured again."""
    p = _metric(spark, sf_dir)
    yaw = F.degrees(0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y")))
    r = p.groupBy("scan_id", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), yaw.alias("yaw"), (F.max("x") - F.min("x")).alias("length"), (F.max("y") - F.min("y")).alias("width"))
    r = r.join(rooms.bounds(p).withColumn("lo_x", F.col("lo_x") + 2.2), "scan_id")
    found = rooms.snap_yaw(r, p, ["scan_id", "label"])
    return found.select("scan_id", "label", "snapped", *(r6(c).alias(c) for c in ("yaw", "cx", "length")))


def _rect_sql() -> str:
    """Distance of turned rectangles l and r: no separating axis, else the least of 32 distances from corner to edge."""
    def corner(s, a, b):
        return f"({s}.cx + cos({s}.yaw) * {s}.sx / 2 * {a} - sin({s}.yaw) * {s}.sy / 2 * {b})", f"({s}.cy + sin({s}.yaw) * {s}.sx / 2 * {a} + cos({s}.yaw) * {s}.sy / 2 * {b})"

    turns = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    cols = ", ".join(f"{corner(s, *t)[k]} as {s}{i}{'xy'[k]}" for s in "lr" for i, t in enumerate(turns) for k in (0, 1))
    apart = []
    for s in "lr":
        for q in (0, 1):
            u = (f"cos({s}.yaw)", f"sin({s}.yaw)") if not q else (f"(-sin({s}.yaw))", f"cos({s}.yaw)")
            reach = " + ".join(f"abs(cos({o}.yaw) * {u[0]} + sin({o}.yaw) * {u[1]}) * {o}.sx / 2 + abs(cos({o}.yaw) * {u[1]} - sin({o}.yaw) * {u[0]}) * {o}.sy / 2" for o in "lr")
            apart.append(f"abs((r.cx - l.cx) * {u[0]} + (r.cy - l.cy) * {u[1]}) > {reach} + 1e-12")
    dist = []
    for s, o in ("lr", "rl"):
        for i in range(4):
            for j in range(4):
                p, a, b = f"{s}{i}", f"{o}{j}", f"{o}{(j + 1) % 4}"
                t = f"least(greatest((({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / nullif(pow({b}x - {a}x, 2) + pow({b}y - {a}y, 2), 0), 0), 1)"
                dist.append(f"sqrt(pow({p}x - {a}x - {t} * ({b}x - {a}x), 2) + pow({p}y - {a}y - {t} * ({b}y - {a}y), 2))")
    return f"pr as (select l.scan_id, l.box_id as a, r.box_id as b, {' or '.join(apart)} as apart, {cols} from fp l join fp r on l.scan_id = r.scan_id and l.box_id < r.box_id where greatest(l.x0, r.x0) - least(l.x1, r.x1) <= 0.3 and greatest(l.y0, r.y0) - least(l.y1, r.y1) <= 0.3), di as (select scan_id, a, b, case when not apart then 0.0 else least({', '.join(dist)}) end as d from pr)"


@query(f"with {BOXES_SQL}, {boxes_ops.FOOTPRINT_SQL}, {_rect_sql()} select scan_id, a, b, {q6('d')} as clearance from di where d <= 0.3")
def rectangle_clearance(spark, sf_dir):
    """Exact clearance of turned footprints within 0.3 m."""
    pairs = boxes_ops.near_pairs(rooms.with_axes(boxes_ops.footprint(boxes(spark, sf_dir))), 0.3, 0.5)
    found = pairs.select(F.col("l.scan_id").alias("scan_id"), F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), rooms.rectangle_distance().alias("d"))
    return found.filter("d <= 0.3").select("scan_id", "a", "b", r6("d").alias("clearance"))


@query(
    f"""{_P}, {ROOM_BOXES_SQL}, c as (select scan_id, floor(y / 0.4)::bigint as row, floor(x / 0.4)::bigint as col, label from p), bb as (select scan_id, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from c group by 1),
free as (select b.scan_id, r.row, k.col from bb b, lateral (select unnest(range(r0 - 1, r1 + 2)) as row) r, lateral (select unnest(range(c0 - 1, c1 + 2)) as col) k where not exists (select 1 from c where c.scan_id = b.scan_id and c.row = r.row and c.col = k.col and label < 3)),
path as (select * from free where col = 0), i as (select scan_id, box_id as risk_id, floor(cy / 0.4)::bigint as row, floor(cx / 0.4)::bigint as col from boxes where label = 9),
j as (select i.*, exists (select 1 from free f where f.scan_id = i.scan_id and f.row = i.row and f.col = i.col) as in_free from i), d as (select j.scan_id, j.risk_id, min(sqrt(pow(j.row - path.row, 2) + pow(j.col - path.col, 2))) * 0.4 as d from j join path using (scan_id) where in_free group by 1, 2)
select j.scan_id, j.risk_id, in_free, {q6('d.d')} as distance, in_free and coalesce(d.d <= 0.6, not exists (select 1 from path where path.scan_id = j.scan_id)) as in_passage from j left join d using (scan_id, risk_id)"""
)
def passage_intrusion(spark, sf_dir):
    """Seen risks that stand in free cells within 0.6 m of the way through."""
    from habitrace.operators import grid

    free = grid.cells(_metric(spark, sf_dir), 0.4, F.col("label") < 3).filter("not blocked")
    risks = room_boxes(spark, sf_dir).filter("label = 9").select("scan_id", F.col("box_id").alias("risk_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    found = rooms.corridor_intrusion(risks, free, free.filter("col = 0"), 0.4)
    return found.select("scan_id", "risk_id", "in_free", r6("distance").alias("distance"), "in_passage")


_SIZES = "sx as size_x, sy as size_y, sz as size_z"


@query(
    f"""{_P}, {_R}, {ROOM_BOXES_SQL}, b as (select boxes.scan_id, box_id, label, {_SIZES}, boxes.cx, boxes.cy, lo_x, hi_x, lo_y, hi_y from boxes join room using (scan_id)),
c as (select *, case when box_id % 2 = 0 then hi_x - (case when box_id % 3 = 0 then size_y else size_x end) / 2 else lo_x + (case when box_id % 3 = 0 then size_y else size_x end) / 2 end as nx, case when box_id % 4 < 2 then hi_y - (case when box_id % 3 = 0 then size_x else size_y end) / 2 else lo_y + (case when box_id % 3 = 0 then size_x else size_y end) / 2 end as ny, case when box_id % 3 = 0 then 90.0 else 0.0 end as yaw from b where label = 1),
m as (select b.scan_id, b.box_id, 'mounted' as rule, c.nx + 0.1 * cos(radians(c.yaw)) as nx, c.ny + 0.1 * sin(radians(c.yaw)) as ny, c.size_z / 2 + c.size_z / 2 + b.size_z / 2 as nz, c.yaw from b join (select scan_id, max(box_id) as box_id from c group by 1) k using (scan_id) join c on c.box_id = k.box_id where b.label = 4),
w as (select scan_id, box_id, case when box_id % 4 in (0, 2) then case when box_id % 2 = 0 and box_id % 8 < 4 then lo_x + size_x / 2 + 0.2 else hi_x - size_x / 2 - 0.2 end when box_id % 4 = 3 then lo_x + size_y / 2 else hi_x - size_y / 2 end as nx, case when box_id % 4 = 0 then lo_y + size_y / 2 when box_id % 4 = 2 then hi_y - size_y / 2 when box_id % 8 < 4 then lo_y + size_x / 2 + 0.2 else hi_y - size_x / 2 - 0.2 end as ny, size_z / 2 as nz, case when box_id % 4 in (0, 2) then 0.0 else 90.0 end as yaw from b where label = 2),
h as (select b.scan_id, b.box_id, a.nx + (b.size_x + case when a.yaw = 90 then a.size_y else a.size_x end) / 2 + 0.05 as nx, lo_b.lo_y + b.size_y / 2 as ny, b.size_z / 2 as nz from b join room lo_b using (scan_id) join (select scan_id, min(box_id) as box_id from c group by 1) k using (scan_id) join c a on a.box_id = k.box_id where b.label = 3)
select scan_id, box_id, 'corner' as rule, {q6('nx')} as cx, {q6('ny')} as cy, {q6('size_z / 2')} as cz, yaw::double as yaw from c union all select scan_id, box_id, 'wall', {q6('nx')}, {q6('ny')}, {q6('nz')}, yaw::double from w union all select scan_id, box_id, 'beside', {q6('nx')}, {q6('ny')}, {q6('nz')}, 0.0 from h union all select scan_id, box_id, rule, {q6('nx')}, {q6('ny')}, {q6('nz')}, yaw::double from m"""
)
def layout_constraints(spark, sf_dir):
    """Furniture placed by rules: in a corner, along a wall, beside what stands in a corner, mounted on it."""
    b = room_boxes(spark, sf_dir).select("scan_id", "box_id", "label", *(F.col(f"s{a}").alias(f"size_{a}") for a in "xyz")).join(rooms.bounds(_metric(spark, sf_dir)).drop("height"), "scan_id")
    number = F.col("box_id")
    corner = F.concat(F.when(number % 2 == 0, "+x").otherwise("-x"), F.when(number % 4 < 2, ",+y").otherwise(",-y"))
    placed = rooms.place_in_corner(b.filter("label = 1").withColumns({"corner": corner, "long_axis": F.when(number % 3 == 0, "y").otherwise("x")}))
    none = {f"anchor_{k}": F.lit(None).cast("double") for k in ("x", "y", "ex", "ey")}
    wall = b.filter("label = 2").withColumns({"wall_id": number % 4, "direction": F.when(number % 8 < 4, 1.0).otherwise(-1.0), "gap": F.lit(0.0), "offset": F.lit(0.2)} | none)
    flat = F.col("yaw") == 90.0
    first = lambda f: placed.groupBy("scan_id").agg(f(F.struct("box_id", "cx", "cy", "cz", "yaw", "size_x", "size_y", "size_z")).alias("k")).select("scan_id", "k.*")
    anchor = first(F.min).select("scan_id", F.col("cx").alias("anchor_x"), F.col("cy").alias("anchor_y"), F.when(flat, F.col("size_y")).otherwise(F.col("size_x")).alias("anchor_ex"), F.when(flat, F.col("size_x")).otherwise(F.col("size_y")).alias("anchor_ey"))
    beside = b.filter("label = 3").withColumns({"wall_id": F.lit(0), "direction": F.lit(1.0), "gap": F.lit(0.05), "offset": F.lit(0.0)}).join(anchor, "scan_id")
    parent = first(F.max).select("scan_id", *(F.col(f"c{a}").alias(f"parent_{a}") for a in "xyz"), F.col("size_z").alias("parent_height"), F.col("yaw").alias("parent_yaw"))
    mounted = b.filter("label = 4").withColumn("along", F.lit(0.1)).join(parent, "scan_id")
    show = lambda f, rule: f.select("scan_id", "box_id", F.lit(rule).alias("rule"), r6("cx").alias("cx"), r6("cy").alias("cy"), r6("cz").alias("cz"), F.col("yaw").cast("double").alias("yaw"))
    return show(placed, "corner").union(show(rooms.place_on_wall(wall), "wall")).union(show(rooms.place_on_wall(beside), "beside")).union(show(rooms.place_on_parent(mounted), "mounted"))
