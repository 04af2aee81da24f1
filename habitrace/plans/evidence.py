"""Further filters, fits and evidence on clouds, frames and layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from habitrace.operators import grid, instances, planes, rooms, spatial, views
from habitrace.operators import layout as boxes_ops
from habitrace.plans.define import q6, query, r6
from habitrace.plans.rooms import _P, _R, _metric
from habitrace.plans.scans import _OPENED, obstacle_grid
from habitrace.sources import layout_text
from habitrace.sources.driver_tables import BOXES_SQL, FRAMES_SQL, POINTS_SQL, ROOM_BOXES_SQL, ROOM_POINTS_SQL, boxes, frames, points, room_boxes, room_points, table

_X, _B, _F = f"with {ROOM_POINTS_SQL}", f"with {ROOM_BOXES_SQL}", f"with {FRAMES_SQL}"


def _legacy_sql() -> str:
    turns = ((-1, -1), (-1, 1), (1, -1), (1, 1))
    at = lambda s, a, b: (f"{s}.cx + cos({s}.yaw) * {s}.sx / 2 * {a} - sin({s}.yaw) * {s}.sy / 2 * {b}", f"{s}.cy + sin({s}.yaw) * {s}.sx / 2 * {a} + cos({s}.yaw) * {s}.sy / 2 * {b}")
    cols = ", ".join(f"{at(s, *t)[k]} as {s}{i}{'xy'[k]}" for s in "lr" for i, t in enumerate(turns) for k in (0, 1))
    gaps = []
    for s in "lr":
        for i in range(4):
            a, b = f"{s}{i}", f"{s}{(i + 1) % 4}"
            n = f"greatest(sqrt(pow({b}x - {a}x, 2) + pow({b}y - {a}y, 2)), 1e-12)"
            shadow = {o: ", ".join(f"({o}{j}x * -({b}y - {a}y) + {o}{j}y * ({b}x - {a}x)) / {n}" for j in range(4)) for o in "lr"}
            gaps.append(f"greatest(least({shadow['l']}), least({shadow['r']})) - least(greatest({shadow['l']}), greatest({shadow['r']}))")
    least = "list_min(list_filter([" + ", ".join(gaps) + "], lambda g: g > 1e-9))"
    return f"pr as (select l.box_id as a, r.box_id as b, {cols} from fp l join fp r on l.scan_id = r.scan_id and l.box_id < r.box_id where greatest(l.x0, r.x0) - least(l.x1, r.x1) <= 0.3 and greatest(l.y0, r.y0) - least(l.y1, r.y1) <= 0.3) select a, b, {q6(f'coalesce({least}, 0.0)')} as gap from pr"


@query(f"with {BOXES_SQL}, {boxes_ops.FOOTPRINT_SQL}, {_legacy_sql()}")
def legacy_clearance(spark, sf_dir):
    """The older, approximate gap of footprints that are near."""
    pairs = boxes_ops.near_pairs(rooms.with_axes(boxes_ops.footprint(boxes(spark, sf_dir))), 0.3, 0.5)
    return pairs.select(F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), r6(rooms.legacy_gap()).alias("gap"))


_MODEL = "['PINHOLE', 'SIMPLE_RADIAL', 'RADIAL', 'FISHEYE'][label % 4 + 1]"
_FACTOR = f"case {_MODEL} when 'PINHOLE' then 1 when 'SIMPLE_RADIAL' then 1 + 0.1 * r2 when 'RADIAL' then 1 + 0.1 * r2 + 0.02 * r2 * r2 end"


@query(f"{_X}, c as (select point_id, label, x, y, z + 2 as d, (x*x + y*y) / ((z + 2) * (z + 2)) as r2 from points) select point_id, {q6(f'500 * ({_FACTOR}) * x / d + 320')} as u, {q6(f'500 * ({_FACTOR}) * y / d + 240')} as v from c where d > 0.1 and label % 4 < 3")
def camera_models(spark, sf_dir):
    """Projection by camera model, with radial terms; views of an unknown model are left out."""
    model = F.array(*map(F.lit, ("PINHOLE", "SIMPLE_RADIAL", "RADIAL", "FISHEYE")))[(F.col("label") % 4).cast("int")]
    u, v = views.camera_pixel(model, F.col("x"), F.col("y"), F.col("z") + 2, 500.0, 320.0, 240.0, 0.1, 0.02)
    return room_points(spark, sf_dir).filter("z + 2 > 0.1").select("point_id", r6(u).alias("u"), r6(v).alias("v")).filter("u is not null")


@query(f"{_B} select box_id, {q6('-(cos(yaw) * cx + sin(yaw) * cy)')} as px, {q6('-(-sin(yaw) * cx + cos(yaw) * cy)')} as py, {q6('-cz')} as pz, 1.0::double as dz from boxes")
def camera_centres(spark, sf_dir):
    """Centre and direction of cameras kept as world to camera."""
    c, s = F.cos("yaw"), F.sin("yaw")
    zero, one = F.lit(0.0), F.lit(1.0)
    centre, towards = views.inverted([[c, -s, zero], [s, c, zero], [zero, zero, one]], [F.col(k) for k in ("cx", "cy", "cz")])
    return room_boxes(spark, sf_dir).select("box_id", *(r6(v).alias(n) for v, n in zip(centre, ("px", "py", "pz"))), r6(towards[2]).alias("dz"))


_MOM = "avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) as xx, covar_pop(x, y) as xy, var_pop(y) as yy, covar_pop(x, z) as xz, covar_pop(y, z) as yz"
_AB = "(xz * yy - yz * xy) / (xx * yy - xy * xy) as a, (yz * xx - xz * xy) / (xx * yy - xy * xy) as b"


@query(
    f"""{_X}, m as (select scan_id, {_MOM} from points group by 1), f as (select scan_id, {_AB}, mx, my, mz from m), r as (select p.scan_id, x, y, z, abs(z - a * x - b * y - (mz - a * mx - b * my)) as e from points p join f using (scan_id)), q as (select scan_id, quantile_cont(e, 0.9) as cut from r group by 1),
m2 as (select r.scan_id, {_MOM} from r join q using (scan_id) where e <= cut group by 1), f2 as (select scan_id, {_AB}, mx, my, mz from m2) select scan_id, {q6('a')} as a, {q6('b')} as b, {q6('mz - a * mx - b * my')} as c, {q6('sqrt(a * a + b * b)')} as slope from f2"""
)
def floor_plane(spark, sf_dir):
    """The floor as a plane, fitted again on the best nine tenths."""
    return planes.floor_plane(room_points(spark, sf_dir)).select("scan_id", *(r6(c).alias(c) for c in ("a", "b", "c", "slope")))


@query()
def robust_similarity(spark, sf_dir):
    """A similarity with a tenth of the pairs spoilt: five refits on the best 72 % find it."""
    import math

    c, s, spoilt = math.cos(math.radians(27)), math.sin(math.radians(27)), F.when(F.col("point_id") % 10 == 0, 3.0).otherwise(0.0)
    p = room_points(spark, sf_dir)
    q = p.select("scan_id", "x", "y", "z", (1.37 * (c * F.col("x") - s * F.col("y")) + 0.5 + spoilt).alias("u"), (1.37 * (s * F.col("x") + c * F.col("y")) - 0.2).alias("v"), (1.37 * F.col("z") + 1).alias("w"))
    found = planes.similarity(q)
    return found.select("scan_id", r6("scale").alias("scale"), *(r6(F.col("shift")[i]).alias(f"t{i}") for i in range(3)))


_MARGINS = {"passage": (0.0, 0.0, 0.0), "opening": (0.08, 0.08, 0.08), "candidate": (0.10, 0.10, 0.10), "instance": (0.12, 0.12, 0.08), "structure": (0.12, 0.12, 0.12), "support": (0.15, 0.15, 0.10)}


@query(f"with {BOXES_SQL}, {POINTS_SQL}, p as (select scan_id, point_id, x * 10 as x, y * 10 as y, z * 10 as z from points)" + " union all ".join(f" select '{n}' as variant, b.box_id, count(*) as n from p join boxes b on p.scan_id = b.scan_id and {spatial.in_obb_sql('p', 'b', *m)} group by 2" for n, m in _MARGINS.items()))
def box_margins(spark, sf_dir):
    """Points in boxes under the six margins that the stages use; one join at the widest, the others from it."""
    p = points(spark, sf_dir).select("scan_id", "point_id", *((F.col(c) * 10).alias(c) for c in "xyz"))
    b = boxes(spark, sf_dir)
    wide = spatial.points_in_boxes(p, b, (0.15, 0.15, 0.12), 0.5).alias("m").join(p.alias("p"), ["scan_id", "point_id"]).join(b.select("box_id", "cx", "cy", "cz", "sx", "sy", "sz", "yaw"), "box_id")
    box = {k: F.col(k) for k in ("cx", "cy", "cz", "sx", "sy", "sz", "yaw")}
    inside = F.array_compact(F.array(*(F.when(spatial.in_obb(F.col("x"), F.col("y"), F.col("z"), box, *m), F.lit(n)) for n, m in _MARGINS.items())))
    return wide.select("box_id", F.explode(inside).alias("variant")).groupBy("variant", "box_id").agg(F.count("*").alias("n"))


@query(f"{_X} select point_id, case when z <= -0.3 then 'floor' when abs(x) >= 0.3 - 0.04 then 'wall' end as removed_by from points")
def structural_filter(spark, sf_dir):
    """Points of floor and walls with what removes them (the floor first); the others are kept."""
    return room_points(spark, sf_dir).select("point_id", F.when(F.col("z") <= -0.3, "floor").when(F.abs("x") >= 0.3 - 0.04, "wall").alias("removed_by"))


_ENDS = "count(*) filter (where t {o} {q}) as n_{e}, avg((z < 0)::int) filter (where t {o} {q}) as s_{e}"


@query(
    f"""{_X}, a as (select scan_id, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) as angle from points group by 1), p as (select points.*, x * cos(angle) + y * sin(angle) as t from points join a using (scan_id)),
q as (select scan_id, min(t) + 0.15 * (max(t) - min(t)) as lo, max(t) - 0.15 * (max(t) - min(t)) as hi, count(*) as n from p group by 1), e as (select p.scan_id, {_ENDS.format(o='<', q='lo', e='lo')}, {_ENDS.format(o='>', q='hi', e='hi')} from p join q using (scan_id) group by 1)
select p.scan_id, p.point_id from p join q using (scan_id) join e using (scan_id) where not (t < lo and s_lo >= 0.55 and n_lo < 0.3 * n and n >= 50) and not (t > hi and s_hi >= 0.55 and n_hi < 0.3 * n and n >= 50)"""
)
def bed_frame_trim(spark, sf_dir):
    """Points without the end frames of a bed: ends of 15 % along the main axis that are mostly low and hold under 30 %."""
    p = room_points(spark, sf_dir)
    a = p.groupBy("scan_id").agg(spatial.principal_angle("x", "y").alias("angle"))
    t = p.join(a, "scan_id").withColumn("t", F.col("x") * F.cos("angle") + F.col("y") * F.sin("angle")).select("scan_id", "point_id", "t", "z")
    q = t.groupBy("scan_id").agg((F.min("t") + 0.15 * (F.max("t") - F.min("t"))).alias("lo"), (F.max("t") - 0.15 * (F.max("t") - F.min("t"))).alias("hi"), F.count("*").alias("n"))
    j = t.join(q, "scan_id")
    low = (F.col("z") < 0).cast("int")
    at = {"lo": F.col("t") < F.col("lo"), "hi": F.col("t") > F.col("hi")}
    e = j.groupBy("scan_id").agg(*(x for k, c in at.items() for x in (F.count_if(c).alias(f"n_{k}"), F.avg(F.when(c, low)).alias(f"s_{k}"))))
    cut = lambda k: at[k] & F.coalesce(F.col(f"s_{k}") >= 0.55, F.lit(False)) & (F.col(f"n_{k}") < 0.3 * F.col("n")) & (F.col("n") >= 50)
    return j.join(e, "scan_id").filter(~cut("lo") & ~cut("hi")).select("scan_id", "point_id")


@query(
    f"""{_F}, f as (select scan_id, kind, view_id, min(frame_id) as first from frames group by 1, 2, 3), s as (select scan_id, kind, floor(first / 400)::bigint as step, count(*) as new from f group by 1, 2, 3), c as (select *, sum(new) over (partition by scan_id, kind order by step) as total, row_number() over (partition by scan_id, kind order by step desc) as back from s)
select scan_id, kind, {q6('exp(-3 * avg(new / total) filter (where back <= 3))')} as stability, max(total)::bigint as seen from c group by 1, 2"""
)
def boundary_stability(spark, sf_dir):
    """How settled an instance is: exp(-3 x the mean share of what is new in the last three steps)."""
    first = frames(spark, sf_dir).groupBy("scan_id", "kind", "view_id").agg(F.min("frame_id").alias("first"))
    s = first.groupBy("scan_id", "kind", F.floor(F.col("first") / 400).alias("step")).agg(F.count("*").alias("new"))
    w = Window.partitionBy("scan_id", "kind")
    c = s.withColumns({"total": F.sum("new").over(w.orderBy("step")), "back": F.row_number().over(w.orderBy(F.desc("step")))})
    return c.groupBy("scan_id", "kind").agg(r6(F.exp(-3 * F.avg(F.when(F.col("back") <= 3, F.col("new") / F.col("total"))))).alias("stability"), F.max("total").alias("seen"))


@query(
    f"""{_X}, v as (select scan_id, floor(x / 0.3)::bigint as vx, floor(y / 0.3)::bigint as vy, count(distinct label) as frames, max(abs(z)) as conf, count(*) as n from points group by 1, 2, 3), b as (select scan_id, count(*) as base from points where label < 3 group by 1),
k as (select *, row_number() over (partition by scan_id order by conf desc, vx, vy) as r from v where frames >= 4 and conf >= 0.15) select k.scan_id, vx, vy, frames, n from k join b using (scan_id) where r <= floor(0.3 * base)"""
)
def anchored_consensus(spark, sf_dir):
    """Voxels that four frames see with confidence, the surest first, never more than 30 % of the base (the cap is the rule)."""
    p = room_points(spark, sf_dir)
    v = p.groupBy("scan_id", spatial.cell("x", 0.3).alias("vx"), spatial.cell("y", 0.3).alias("vy")).agg(F.countDistinct("label").alias("frames"), F.max(F.abs("z")).alias("conf"), F.count("*").alias("n"))
    base = p.filter("label < 3").groupBy("scan_id").agg(F.count("*").alias("base"))
    r = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("conf"), "vx", "vy"))
    kept = v.filter("frames >= 4 and conf >= 0.15").withColumn("r", r).join(base, "scan_id").filter("r <= floor(0.3 * base)")
    return kept.select("scan_id", "vx", "vy", "frames", "n")


@query("select l_orderkey as scan_id, l_linenumber as item_id, 'bed' as class, l_quantity as cx, 0.5::double as yaw, l_tax as sx from lineitem where l_returnflag = 'A'")
def layout_boxes(spark, sf_dir):
    """Boxes of layout text: class, centre, turn and sizes."""
    l = table(spark, sf_dir, "lineitem")
    numbers = F.concat_ws(", ", F.lit("bed"), F.col("l_quantity").cast("string"), F.lit("1"), F.lit("2"), F.lit("0.5"), F.col("l_tax").cast("string"), F.lit("1"), F.lit("1"))
    line = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("bbox_"), F.col("l_linenumber").cast("string"), F.lit("=Bbox("), numbers, F.lit(")"))).otherwise(F.lit("bbox_1=Bbox(bed, x)"))
    found = layout_text.boxes(layout_text.parse_layout(l.select(F.col("l_orderkey").alias("scan_id"), line.alias("line"))))
    return found.select("scan_id", "item_id", "class", "cx", "yaw", "sx")


@query(
    f"""with recursive {ROOM_POINTS_SQL}, {_OPENED}, n as (select *, row * 4294967296 + col as node from op),
r as (select scan_id, node, node as lab from n union select r.scan_id, b.node, r.lab from r join n a on a.scan_id = r.scan_id and a.node = r.node join n b on b.scan_id = a.scan_id and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1), k as (select scan_id, node, min(lab) as component from r group by 1, 2)
select k.scan_id, component, count(*) as cells, min(row) as row0, max(row) as row1, min(col) as col0, max(col) as col1, {q6('quantile_cont(low, 0.2)')} as low, {q6('quantile_cont(high, 0.9)')} as high from k join n on n.scan_id = k.scan_id and n.node = k.node group by 1, 2 having count(*) >= 5"""
)
def obstacle_boxes(spark, sf_dir):
    """Obstacles: cells of the opened height grid joined over eight neighbours, with their boxes; five cells or more here."""
    found = grid.obstacles(obstacle_grid(spark, sf_dir), 5)
    return found.select("scan_id", "component", "cells", "row0", "row1", "col0", "col1", r6("low").alias("low"), r6("high").alias("high"))


@query(
    f"""{_P}, {_R}, m as (select scan_id, case when label % 2 = 0 then 'door' else 'window' end as kind, label as view_id, x, y, z from p where label < 6),
n as (select scan_id, kind, count(distinct view_id) as views, count(*) as n, quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my from m group by 1, 2 having count(distinct view_id) >= 2 and count(*) >= 30),
w as (select n.*, r.height as room, v.id as wall_id, (lo_x + hi_x) / 2 as cx, (lo_y + hi_y) / 2 as cy, case when v.id % 2 = 0 then hi_x - lo_x else hi_y - lo_y end as length, row_number() over (partition by n.scan_id, kind order by case v.id when 0 then abs(my - lo_y) when 1 then abs(mx - hi_x) when 2 then abs(my - hi_y) else abs(mx - lo_x) end, v.id) as k from n join room r using (scan_id) cross join (values (0), (1), (2), (3)) v(id)),
q as (select w.scan_id, w.kind, wall_id, views, n, room, length, quantile_cont(case when wall_id % 2 = 1 then m.y - cy else m.x - cx end, 0.05) as a0, quantile_cont(case when wall_id % 2 = 1 then m.y - cy else m.x - cx end, 0.95) as a1, quantile_cont(m.z, 0.05) as z0, quantile_cont(m.z, 0.95) as z1 from w join m on m.scan_id = w.scan_id and m.kind = w.kind where k = 1 group by all),
t as (select *, case when kind = 'door' then 0 else greatest(z0, 0.35) end as bottom, case when kind = 'door' then z1 else least(z1, room - 0.15) end as top from q)
select scan_id, kind, wall_id, {q6('(a0 + a1) / 2')} as along, {q6('least(greatest(a1 - a0, 0.3), greatest(length, 0.3))')} as width, {q6('bottom')} as bottom, {q6("least(greatest(top - bottom, 0.35), case when kind = 'door' then room else least(1.8, room - 0.5) end)")} as height, views, n from t"""
)
def missing_openings(spark, sf_dir):
    """Openings from what several views' masks see, where the layout has none."""
    p = _metric(spark, sf_dir)
    room = rooms.bounds(p)
    seen = p.filter("label < 6").select("scan_id", F.when(F.col("label") % 2 == 0, "door").otherwise("window").alias("kind"), F.col("label").alias("view_id"), "x", "y", "z")
    found = rooms.missing_openings(seen, rooms.walls(room), room)
    return found.select("scan_id", "kind", "wall_id", *(r6(c).alias(c) for c in ("along", "width", "bottom", "height")), "views", "n")


@query()
def room_frames(spark, sf_dir):
    """Floor normal, main wall direction and confidence of each scan, with the cameras' up hint."""
    p = _metric(spark, sf_dir)
    up = p.select("scan_id").distinct().select("scan_id", F.lit(0.0).alias("ux"), F.lit(0.0).alias("uy"), F.lit(1.0).alias("uz"))
    found = planes.room_frame(p, up)
    return found.select("scan_id", *(r6(c).alias(c) for c in ("nx", "ny", "nz", "ax", "ay", "az", "ratio")), "method", "confidence")


def _instances(spark, sf_dir):
    return _metric(spark, sf_dir).select((F.col("scan_id") * 100 + F.col("label")).alias("scan_id"), "point_id", "x", "y", "z")


@query()
def instance_robust_geometry(spark, sf_dir):
    """Robust footprint, height and stability of each instance (scan x 100 + label)."""
    found = instances.robust(_instances(spark, sf_dir))
    return found.select(F.col("scan_id").alias("instance_id"), "n", "kept", *(r6(c).alias(c) for c in ("length", "width", "low", "high", "stability")))


@query()
def instance_fits(spark, sf_dir):
    """The fit of each instance and why it is not verified; ten points are enough here."""
    found = instances.fitted(_instances(spark, sf_dir), 4, 1.6, 10)
    return found.select(F.col("scan_id").alias("instance_id"), "points", *(r6(c).alias(c) for c in ("length", "width", "low", "high", "confidence")), "status", "reason")


@query()
def object_fits(spark, sf_dir):
    """Candidate boxes fitted to their points, without earlier objects' and other clusters' points."""
    p = _metric(spark, sf_dir)
    wide = room_boxes(spark, sf_dir).filter("label < 3").withColumns({"sx": F.col("sx") * 8, "sy": F.col("sy") * 8, "sz": F.lit(20.0)})
    found = instances.fit_in_boxes(p, wide, rooms.bounds(p), least=3, reach=1.0)
    return found.select("scan_id", "box_id", "points", *(r6(c).alias(c) for c in ("cx", "cy", "sx", "sy", "low", "high")))


@query(
    f"""{_B}, {ROOM_POINTS_SQL}, p as (select scan_id, x * 10 as x, y * 10 as y, z * 10 as z from points), n as (select b.box_id, count(p.x) as n from boxes b left join p on p.scan_id = b.scan_id and abs(cos(yaw) * (p.x - cx) + sin(yaw) * (p.y - cy)) < sx / 2 + 0.18 and abs(cos(yaw) * (p.y - cy) - sin(yaw) * (p.x - cx)) < sy / 2 + 0.18 and p.z - cz > 0.05 and p.z - cz < sz + 0.20 group by 1)
select box_id, n, case when label in (7, 8, 9) then 'small_object' when n < 3 then 'insufficient_point_region' else 'refine' end as status, case when label < 4 then 0.25 else 0.12 end::double as search from n join boxes using (box_id)"""
)
def refinement_gate(spark, sf_dir):
    """Boxes that a refinement by images would skip: small things, too few points around; and how far it would search."""
    p = room_points(spark, sf_dir).select("scan_id", "point_id", *((F.col(c) * 10).alias(c) for c in "xyz"))
    b = room_boxes(spark, sf_dir)
    met = spatial.points_in_boxes(p, b.withColumn("sz", F.col("sz") * 4 + 1), (0.18, 0.18, 0.0), 0.5).join(p, ["scan_id", "point_id"]).join(b.drop("scan_id"), "box_id")
    dx, dy, dz = (F.col(a) - F.col(f"c{a}") for a in "xyz")
    c, s = F.cos("yaw"), F.sin("yaw")
    near = (F.abs(c * dx + s * dy) < F.col("sx") / 2 + 0.18) & (F.abs(c * dy - s * dx) < F.col("sy") / 2 + 0.18) & (dz > 0.05) & (dz < F.col("sz") + 0.20)
    n = b.join(met.filter(near).groupBy("box_id").agg(F.count("*").alias("n")), "box_id", "left").fillna(0, ["n"])
    status = F.when(F.col("label").isin(7, 8, 9), "small_object").when(F.col("n") < 3, "insufficient_point_region").otherwise("refine")
    return n.select("box_id", "n", status.alias("status"), F.when(F.col("label") < 4, 0.25).otherwise(0.12).alias("search"))


@query(f"{_X} select scan_id, label, {q6('case when label in (0, 1, 2, 3) then quantile_cont(z, 0.9) - quantile_cont(z, 0.02) when label = 4 then quantile_cont(z, 0.99) - quantile_cont(z, 0.02) else quantile_cont(z, 0.98) - quantile_cont(z, 0.02) end')} as height from points group by 1, 2")
def instance_heights(spark, sf_dir):
    """Heights by class: flat tops to the 90th percentile, sofas to the 99th, the robust range for all else."""
    q = F.percentile("z", F.array(*(F.lit(v) for v in (0.02, 0.9, 0.98, 0.99))))
    p = room_points(spark, sf_dir).groupBy("scan_id", "label").agg(q.alias("q"))
    top = F.when(F.col("label").isin(0, 1, 2, 3), F.col("q")[1]).when(F.col("label") == 4, F.col("q")[3]).otherwise(F.col("q")[2])
    return p.select("scan_id", "label", r6(top - F.col("q")[0]).alias("height"))


@query("with r as (select l_orderkey as scan_id, l_linenumber as item_id, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end as place from lineitem where l_discount >= 0.05) select scan_id, min_by(item_id, {'p': place, 'n': item_id}) as item_id, min(place)::int as place from r group by 1")
def preferred_reference(spark, sf_dir):
    """The first eligible reference by the list of preference: door, bed, anything else."""
    prefer = spark.createDataFrame([("R", 0), ("A", 1), ("N", 2)], "l_returnflag string, place int")
    r = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.05").join(prefer, "l_returnflag")
    best = r.groupBy(F.col("l_orderkey").alias("scan_id")).agg(F.min(F.struct("place", F.col("l_linenumber").alias("n"))).alias("b"))
    return best.select("scan_id", F.col("b.n").alias("item_id"), "b.place")


@query(
    f"""{_X}, h as (select scan_id, label as component, point_id // 5 % 5 as candidate, count(*) as hits from points group by 1, 2, 3), z as (select scan_id, label as component, count(*) as size from points group by 1, 2),
e as (select h.*, hits / size as share, candidate % 2 = component % 2 as fits from h join z using (scan_id, component)) select scan_id, component, {q6('coalesce(max(share) filter (where fits and hits >= 3 and share >= 0.05), 0)')} as compatible, {q6('coalesce(max(share) filter (where not fits and hits >= 3 and share >= 0.05), 0)')} as conflicting from e group by 1, 2"""
)
def component_evidence(spark, sf_dir):
    """The greatest share of a component that candidates of its own group, and of others, cover (three points and 5 % at least)."""
    p = room_points(spark, sf_dir).select("scan_id", F.col("label").alias("component"), (F.floor(F.col("point_id") / 5) % 5).alias("candidate"))
    size = p.groupBy("scan_id", "component").agg(F.count("*").alias("size"))
    e = p.groupBy("scan_id", "component", "candidate").agg(F.count("*").alias("hits")).join(size, ["scan_id", "component"]).withColumn("share", F.col("hits") / F.col("size"))
    counts = (F.col("hits") >= 3) & (F.col("share") >= 0.05)
    fits = F.col("candidate") % 2 == F.col("component") % 2
    best = lambda c: r6(F.coalesce(F.max(F.when(counts & c, F.col("share"))), F.lit(0.0)))
    return e.groupBy("scan_id", "component").agg(best(fits).alias("compatible"), best(~fits).alias("conflicting"))
