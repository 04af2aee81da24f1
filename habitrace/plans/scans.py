"""Sources, filters and fits on clouds that complete the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from habitrace.operators import density, exact, graph, grid, sampling, spatial, views
from habitrace.plans.define import q6, query, r6
from habitrace.session import new_path, settled
from habitrace.sources import ply
from habitrace.sources import ply_source as ply_files
from habitrace.sources.driver_tables import FRAMES_SQL, POINTS_SQL, ROOM_BOXES_SQL, ROOM_POINTS_SQL, frames, points, room_boxes, room_points, table

_P = f"with {ROOM_POINTS_SQL}"
_B = f"with {ROOM_BOXES_SQL}"
_F = f"with {FRAMES_SQL}"


@query(f"{_P} select scan_id, row_number() over (partition by scan_id order by point_id) - 1 as point_id, x::float::double as x, y::float::double as y, z::float::double as z from points")
def ply_roundtrip(spark, sf_dir):
    """Clouds written as PLY files and read again: single precision, order kept."""
    return ply.decoded(ply.encoded(room_points(spark, sf_dir)))


@query(f"{_P} select scan_id, row_number() over (partition by scan_id order by point_id) - 1 as point_id, x::float::double as x, (label / 10.0)::float::double as red, abs(y)::float::double as green, abs(z)::float::double as blue from points")
def ply_colours(spark, sf_dir):
    """Clouds with float colours (six properties) written and read again."""
    colours = {"red": F.col("label") / 10.0, "green": F.abs("y"), "blue": F.abs("z")}
    files = ply.encoded(room_points(spark, sf_dir).withColumns(colours), extra=tuple(colours))
    return ply.decoded(files, tuple(colours)).select("scan_id", "point_id", "x", *colours)


@query(f"{_P} select scan_id, row_number() over (partition by scan_id order by point_id) - 1 as point_id, x::float::double as x, y::float::double as y, z::float::double as z, (label / 10.0)::float::double as red from points")
def ply_source(spark, sf_dir):
    """Clouds written by the data source "ply" and read again, numbered through a scan's files."""
    path = new_path(spark, "clouds")
    ply_files.write_clouds(room_points(spark, sf_dir).withColumn("red", F.col("label") / 10.0), path, ("red",))
    return ply_files.read_clouds(spark, path, ("red",))


@query(f"{_P}, v as (select scan_id, min(point_id) as point_id from points group by scan_id, floor(x / 0.03), floor(y / 0.03), floor(z / 0.03)), k as (select *, row_number() over (partition by scan_id order by md5(point_id::varchar), point_id) as k from v) select scan_id, point_id from k where k <= 30000")
def preview_sample(spark, sf_dir):
    """A cloud's preview: voxels of 3 cm, at most 30,000 points a scan (the feature)."""
    return sampling.preview(room_points(spark, sf_dir), 0.03, 30000)


@query(f"{_P} select scan_id, point_id, label % 4 as risk from points where (point_id // 5) % 4 = label % 4")
def stride_highlight(spark, sf_dir):
    return room_points(spark, sf_dir).filter("floor(point_id / 5) % 4 = label % 4").select("scan_id", "point_id", (F.col("label") % 4).alias("risk"))


@query("select o_orderkey + 1000000000 as scan_id, o_custkey as project_id, 'cloned' as status, o_orderkey as origin from orders where o_orderpriority like '2%'")
def clone_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("2")).select((F.col("o_orderkey") + 1000000000).alias("scan_id"), F.col("o_custkey").alias("project_id"), F.lit("cloned").alias("status"), F.col("o_orderkey").alias("origin"))


@query(f"{_P}, e as (select label, quantile_cont(x, 0.15) as lo, quantile_cont(x, 0.85) as hi from points group by 1), s as (select p.label, count(*) filter (where x < lo) as n_lo, avg((z < 0)::int) filter (where x < lo) as s_lo, avg((z < 0)::int) filter (where x > hi) as s_hi from points p join e using (label) group by 1) select label, n_lo, s_lo >= 0.55 as trim_low, s_hi >= 0.55 as trim_high from s")
def bed_end_trim(spark, sf_dir):
    """Which ends of an instance (15% margins) are mostly low points and would be trimmed."""
    p = room_points(spark, sf_dir)
    e = p.groupBy("label").agg(F.percentile("x", F.array(F.lit(0.15), F.lit(0.85))).alias("q"))
    low = (F.col("z") < 0).cast("int")
    at_lo, at_hi = F.col("x") < F.col("q")[0], F.col("x") > F.col("q")[1]
    s = p.join(e, "label").groupBy("label").agg(F.count_if(at_lo).alias("n_lo"), F.avg(F.when(at_lo, low)).alias("lo"), F.avg(F.when(at_hi, low)).alias("hi"))
    return s.select("label", "n_lo", (F.col("lo") >= 0.55).alias("trim_low"), (F.col("hi") >= 0.55).alias("trim_high"))


@query(f"{_P}, c as (select *, max(z) over w - min(z) over w > 0.3 as tall, count(*) over (partition by scan_id) as n from points window w as (partition by scan_id, floor(x / 0.08))), k as (select *, count(*) filter (where not tall) over (partition by scan_id) as kept from c) select scan_id, point_id from k where not tall or kept < 0.25 * n or kept < 20")
def wall_sheet(spark, sf_dir):
    """Cells with a tall span are wall; rolled back for scans where too little would stay."""
    cell = Window.partitionBy("scan_id", F.floor(F.col("x") / 0.08))
    scan = Window.partitionBy("scan_id")
    tall = F.max("z").over(cell) - F.min("z").over(cell) > 0.3
    c = room_points(spark, sf_dir).select("scan_id", "point_id", tall.alias("tall"))
    k = c.withColumns({"n": F.count("*").over(scan), "kept": F.count_if(~F.col("tall")).over(scan)})
    return k.filter("not tall or kept < 0.25 * n or kept < 20").select("scan_id", "point_id")


@query(f"{_P}, q as (select label, quantile_cont(z, 0.35) - 0.02 as cut from points group by 1) select p.point_id from points p join q using (label) where p.z > q.cut")
def flat_surface(spark, sf_dir):
    p = room_points(spark, sf_dir)
    q = p.groupBy("label").agg((F.percentile("z", 0.35) - 0.02).alias("cut"))
    return p.join(q, "label").filter("z > cut").select("point_id")


@query(f"{_B} select o.box_id from boxes o where o.sz >= 0.4 and least(o.sx, o.sy) < 0.25 and o.label between 1 and 5 and exists (select 1 from boxes d where d.label = 0 and d.scan_id = o.scan_id and abs(d.cx - o.cx) < (d.sx + o.sx) / 2 and abs(d.cy - o.cy) < (d.sy + o.sy) / 2)")
def closed_door_reject(spark, sf_dir):
    """Tall thin objects over a door are its closed panel."""
    b = room_boxes(spark, sf_dir)
    o = b.filter("sz >= 0.4 and least(sx, sy) < 0.25 and label between 1 and 5").alias("o")
    d = b.filter("label = 0").alias("d")
    near = (F.col("d.scan_id") == F.col("o.scan_id")) & (F.abs(F.col("d.cx") - F.col("o.cx")) < (F.col("d.sx") + F.col("o.sx")) / 2) & (F.abs(F.col("d.cy") - F.col("o.cy")) < (F.col("d.sy") + F.col("o.sy")) / 2)
    return o.join(d, near, "left_semi").select("box_id")


@query("select o_orderkey as scan_id, coalesce(max(case when l_returnflag = 'A' then l_linenumber end), min(l_linenumber), 0) as file_id, max(case when l_returnflag = 'A' then 1 else 0 end) = 1 as accepted from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def preview_selection(spark, sf_dir):
    """An accepted file, else the baseline, else none (0)."""
    l = table(spark, sf_dir, "lineitem")
    pick = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))).alias("ok"), F.min("l_linenumber").alias("base"))
    j = table(spark, sf_dir, "orders").select("o_orderkey").distinct().join(pick, "o_orderkey", "left")
    return j.select(F.col("o_orderkey").alias("scan_id"), F.coalesce("ok", "base", F.lit(0)).alias("file_id"), F.col("ok").isNotNull().alias("accepted"))


@query(f"{_F}, e as (select scan_id, kind, count(distinct view_id) as views, count(*) as pts from frames group by 1, 2) select scan_id, kind, case when views >= 3 and pts >= 10 then 'high' when views >= 2 and pts > 0 then 'medium' when pts > 0 then 'low' else 'unknown' end as evidence from e")
def evidence_level(spark, sf_dir):
    e = frames(spark, sf_dir).groupBy("scan_id", "kind").agg(F.countDistinct("view_id").alias("views"), F.count("*").alias("pts"))
    level = F.when((F.col("views") >= 3) & (F.col("pts") >= 10), "high").when((F.col("views") >= 2) & (F.col("pts") > 0), "medium").when(F.col("pts") > 0, "low").otherwise("unknown")
    return e.select("scan_id", "kind", level.alias("evidence"))


_ANGLE = "acos(greatest(least((a.x*b.x + a.y*b.y + a.z*b.z) / (sqrt(a.x*a.x + a.y*a.y + a.z*a.z) * sqrt(b.x*b.x + b.y*b.y + b.z*b.z)), 1), -1))"


@query(
    f"""with {POINTS_SQL}, p as (select a.scan_id, max({_ANGLE}) as widest, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) as baseline from points a join points b on a.scan_id = b.scan_id and a.point_id < b.point_id group by 1)
select scan_id, {q6('widest')} as widest, {q6('baseline')} as baseline, {q6('0.7 * least(widest / (pi() / 2), 1) + 0.3 * least(baseline / 0.8, 1)')} as diversity from p"""
)
def view_diversity(spark, sf_dir):
    """Widest angle (70 %) and longest baseline over the object's scale (30 %) of all of a scan's views."""
    found = views.diversity(points(spark, sf_dir), F.lit(0.8))
    return found.select("scan_id", *(r6(c).alias(c) for c in ("widest", "baseline", "diversity")))


@query(f"{_P}, s as (select *, case when x * first_value(x) over w + y * first_value(y) over w + z * first_value(z) over w < 0 then -1 else 1 end as sg from points window w as (partition by scan_id order by point_id rows between unbounded preceding and unbounded following)) select scan_id, " + ", ".join(f"{q6(f'quantile_cont(sg * {c}, 0.5)')} as u{c}" for c in "xyz") + " from s group by 1")
def camera_up_hint(spark, sf_dir):
    """Median of image-up vectors after turning each to the side of the first."""
    p = room_points(spark, sf_dir)
    first = p.groupBy("scan_id").agg(F.min_by(F.struct("x", "y", "z"), "point_id").alias("f"))
    dot = F.col("x") * F.col("f.x") + F.col("y") * F.col("f.y") + F.col("z") * F.col("f.z")
    s = p.join(first, "scan_id").withColumn("sg", F.when(dot < 0, -1).otherwise(1))
    return s.groupBy("scan_id").agg(*(r6(F.median(F.col("sg") * F.col(c))).alias(f"u{c}") for c in "xyz"))


@query(f"{_P}, m as (select scan_id, regr_slope(z, x) as a, regr_intercept(z, x) as c from points group by 1), r as (select p.scan_id, x, z, abs(z - a * x - c) as e from points p join m using (scan_id)), q as (select scan_id, quantile_cont(e, 0.9) as cut from r group by 1) select r.scan_id, {q6('regr_slope(z, x)')} as slope, {q6('regr_intercept(z, x)')} as base from r join q using (scan_id) where e <= cut group by 1")
def floor_refit(spark, sf_dir):
    """Least squares, then again on the best nine tenths."""
    p = room_points(spark, sf_dir)
    m = p.groupBy("scan_id").agg(F.regr_slope("z", "x").alias("a"), F.regr_intercept("z", "x").alias("c"))
    r = p.join(m, "scan_id").select("scan_id", "x", "z", F.abs(F.col("z") - F.col("a") * F.col("x") - F.col("c")).alias("e"))
    q = r.groupBy("scan_id").agg(F.percentile("e", 0.9).alias("cut"))
    return r.join(q, "scan_id").filter("e <= cut").groupBy("scan_id").agg(r6(F.regr_slope("z", "x")).alias("slope"), r6(F.regr_intercept("z", "x")).alias("base"))


@query(f"{_P} select scan_id, {q6('quantile_cont(x, 0.98) - quantile_cont(x, 0.02)')} as length, {q6('coalesce(quantile_cont(z, 0.95) filter (where z > 0), 0) - quantile_cont(z, 0.05)')} as height, case when count(*) filter (where z > 0) >= 20 then 'ok' else 'fallback' end as method from points group by 1")
def room_dimensions(spark, sf_dir):
    above = F.percentile(F.when(F.col("z") > 0, F.col("z")), 0.95)
    length = F.percentile("x", 0.98) - F.percentile("x", 0.02)
    return room_points(spark, sf_dir).groupBy("scan_id").agg(r6(length).alias("length"), r6(F.coalesce(above, F.lit(0.0)) - F.percentile("z", 0.05)).alias("height"), F.when(F.count_if(F.col("z") > 0) >= 20, "ok").otherwise("fallback").alias("method"))


@query(f"{_F}, e as (select scan_id, kind, count(*) as n, count(distinct view_id) as views, avg(value) as v from frames group by 1, 2) select scan_id, kind, case when views < 2 then 'rejected' when n < 10 then 'ambiguous' when v < 20 then 'weak' when v < 30 then 'usable' else 'clean' end as status, concat_ws(',', case when views < 3 then 'too_few_views' end, case when n < 12 then 'too_few_points' end) as reasons from e")
def observation_status(spark, sf_dir):
    """Five-level purification status with every reason that applies."""
    f = exact.added(frames(spark, sf_dir), ["scan_id", "kind"], "value", "frame_id")
    e = f.groupBy("scan_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("view_id").alias("views"), exact.mean_in_order("value").alias("v"))
    status = F.when(F.col("views") < 2, "rejected").when(F.col("n") < 10, "ambiguous").when(F.col("v") < 20, "weak").when(F.col("v") < 30, "usable").otherwise("clean")
    reasons = F.concat_ws(",", F.when(F.col("views") < 3, "too_few_views"), F.when(F.col("n") < 12, "too_few_points"))
    return e.select("scan_id", "kind", status.alias("status"), reasons.alias("reasons"))


@query(f"{_B} select scan_id, box_id, case when cx - sx / 2 <= -3 and cx + sx / 2 >= 3 then abs(cx) else greatest(case when cx - sx / 2 > -3 then abs(cx - sx / 2 + 1) else 0 end, case when cx + sx / 2 < 3 then abs(cx + sx / 2 - 1) else 0 end) end as residual from boxes")
def censored_residual(spark, sf_dir):
    """Edges at the image border give no constraint; a fully clipped box is held by its centre."""
    lo, hi = F.col("cx") - F.col("sx") / 2, F.col("cx") + F.col("sx") / 2
    edge = F.greatest(F.when(lo > -3, F.abs(lo + 1)).otherwise(0.0), F.when(hi < 3, F.abs(hi - 1)).otherwise(0.0))
    return room_boxes(spark, sf_dir).select("scan_id", "box_id", F.when((lo <= -3) & (hi >= 3), F.abs("cx")).otherwise(edge).alias("residual"))


@query(f"{_P}, r as (select *, row_number() over (partition by label, floor(x * 20), floor(y * 20) order by point_id) as k from points) select point_id from r where k = 1")
def drop_duplicate_observations(spark, sf_dir):
    """The first observation of each (kind, rounded place)."""
    return room_points(spark, sf_dir).groupBy("label", F.floor(F.col("x") * 20), F.floor(F.col("y") * 20)).agg(F.min("point_id").alias("point_id")).select("point_id")


_CELLS = "o as (select distinct scan_id, floor(x / 0.06)::bigint as col, floor(y / 0.06)::bigint as row from points)"


@query(f"{_P}, {_CELLS} select a.scan_id, a.row, a.col, count(b.row) as neighbours from o a left join o b on a.scan_id = b.scan_id and abs(a.row - b.row) + abs(a.col - b.col) = 1 group by 1, 2, 3")
def occupied_neighbours(spark, sf_dir):
    o = room_points(spark, sf_dir).select("scan_id", spatial.cell("x", 0.06).alias("col"), spatial.cell("y", 0.06).alias("row")).distinct()
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c, _ in graph.FOUR))
    told = o.select("scan_id", "row", "col", F.explode(steps).alias("s")).groupBy("scan_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).agg(F.count("*").alias("n"))
    return o.join(told, ["scan_id", "row", "col"], "left").select("scan_id", "row", "col", F.coalesce("n", F.lit(0)).alias("neighbours"))


#: Cells of 0.1 with two points, open from 0.0 up: the clouds are a tenth of a room.
_OPENED = "c as (select scan_id, floor(x / 0.1)::bigint as col, floor(y / 0.1)::bigint as row, quantile_cont(z, 0.05) as low, quantile_cont(z, 0.85) as high from points group by 1, 2, 3 having count(*) >= 2 and quantile_cont(z, 0.85) >= 0.0), bl as (select a.scan_id, a.row, a.col from c a join c b on b.scan_id = a.scan_id and b.row - a.row in (0, 1) and b.col - a.col in (0, 1) group by 1, 2, 3 having count(*) = 4), op as (select distinct c.* from c join bl on bl.scan_id = c.scan_id and c.row - bl.row in (0, 1) and c.col - bl.col in (0, 1))"


def obstacle_grid(spark, sf_dir):
    return grid.obstacle_cells(room_points(spark, sf_dir), 0.1, 2, 0.0)


@query(f"{_P}, {_OPENED} select scan_id, row, col from op")
def grid_opening(spark, sf_dir):
    """Opening of the height grid: cells of full blocks of four."""
    return obstacle_grid(spark, sf_dir).select("scan_id", "row", "col")


@query(f"{_P}, {_CELLS}, b as (select scan_id, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from o group by 1), g as (select b.scan_id, r.row, c.col from b, lateral (select unnest(range(r0, r1 + 1)) as row) r, lateral (select unnest(range(c0, c1 + 1)) as col) c) select g.scan_id, g.row, g.col from g where not exists (select 1 from o where o.scan_id = g.scan_id and o.row = g.row and o.col = g.col)")
def plane_completion(spark, sf_dir):
    """Floor cells of the bounding rectangle that no point observed."""
    o = room_points(spark, sf_dir).select("scan_id", spatial.cell("y", 0.06).alias("row"), spatial.cell("x", 0.06).alias("col")).distinct()
    b = o.groupBy("scan_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    g = b.select("scan_id", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select("scan_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    return g.join(o, ["scan_id", "row", "col"], "left_anti").select("scan_id", "row", "col")


@query(f"{_P} select scan_id, count(*) filter (where z + 2 > 0.1 and abs(500 * x / (z + 2)) <= 20) as forward, count(*) filter (where 2 - z > 0.1 and abs(500 * x / (2 - z)) <= 20) as backward from points group by 1")
def camera_audit(spark, sf_dir):
    """How many points each camera convention would see."""
    seen = lambda d: F.count_if((d > 0.1) & (F.abs(500 * F.col("x") / d) <= 20))
    return room_points(spark, sf_dir).groupBy("scan_id").agg(seen(F.col("z") + 2).alias("forward"), seen(2 - F.col("z")).alias("backward"))


@query(f"{_F}, a as (select * from frames where kind = 'view'), b as (select * from frames where kind = 'click') select a.scan_id, a.view_id, count(*) as pairs, {q6('sum(least(a.value, b.value))')} as confidence from a join b on a.scan_id = b.scan_id and a.view_id = b.view_id group by 1, 2")
def correspondence_join(spark, sf_dir):
    """Equal pixels of two reconstructions; confidence is the lesser of both."""
    f = frames(spark, sf_dir)
    a, b = f.filter("kind = 'view'").select("scan_id", "view_id", F.col("value").alias("va")), f.filter("kind = 'click'").select("scan_id", "view_id", F.col("value").alias("vb"))
    return a.join(b, ["scan_id", "view_id"]).groupBy("scan_id", "view_id").agg(F.count("*").alias("pairs"), r6(F.sum(F.least("va", "vb"))).alias("confidence"))


@query(f"{_F}, k as (select scan_id, kind, value, row_number() over (partition by scan_id, kind order by value, frame_id) as k from frames), t as (select scan_id, kind, max(value) filter (where k = 1) as best, max(value) filter (where k = 2) as second from k where k <= 2 group by 1, 2) select scan_id, kind, coalesce(best < 0.72 * second, false) as accepted from t")
def ratio_test(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("scan_id", "kind").orderBy("value", "frame_id"))
    t = frames(spark, sf_dir).select("scan_id", "kind", "value", k.alias("k")).filter("k <= 2").groupBy("scan_id", "kind").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("second"))
    return t.select("scan_id", "kind", F.coalesce(F.col("best") < 0.72 * F.col("second"), F.lit(False)).alias("accepted"))


@query(f"{_F} select frame_id, view_id, row_number() over (partition by scan_id, view_id order by ts, frame_id) - 1 as mask_id, kind from frames")
def mask_numbers(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("scan_id", "view_id").orderBy("ts", "frame_id")) - 1
    return frames(spark, sf_dir).select("frame_id", "view_id", k.cast("bigint").alias("mask_id"), "kind")


@query(f"{_F}, k as (select scan_id, kind, value, row_number() over (partition by scan_id, kind order by abs(view_id - 50) / 50.0 + 0.015 * value, frame_id) as k from frames) select scan_id, kind, {q6('quantile_cont(value, 0.5)')} as colour from k where k <= 3 group by 1, 2")
def best_three_views(spark, sf_dir):
    """Median colour of the three views that see a surface best: least offset from the image's middle plus 0.015 of the depth."""
    offset = F.abs(F.col("view_id") - 50) / 50.0 + 0.015 * F.col("value")
    k = F.row_number().over(Window.partitionBy("scan_id", "kind").orderBy(offset, "frame_id"))
    return frames(spark, sf_dir).select("scan_id", "kind", "value", k.alias("k")).filter("k <= 3").groupBy("scan_id", "kind").agg(r6(F.median("value")).alias("colour"))


@query(f"{_F}, r as (select scan_id, kind, case when avg(value) > 30 then 2 when avg(value) > 20 then 1 when avg(value) > 10 then 0 else -1 end as rank from frames group by 1, 2) select scan_id, case min(rank) when 2 then 'high' when 1 then 'medium' when 0 then 'low' else 'unknown' end as confidence from r group by 1")
def confidence_minimum(spark, sf_dir):
    v = F.col("v")
    each = exact.added(frames(spark, sf_dir), ["scan_id", "kind"], "value", "frame_id").groupBy("scan_id", "kind").agg(exact.mean_in_order("value").alias("v"))
    r = each.select("scan_id", F.when(v > 30, 2).when(v > 20, 1).when(v > 10, 0).otherwise(-1).alias("rank"))
    names = F.element_at(F.array(F.lit("unknown"), F.lit("low"), F.lit("medium"), F.lit("high")), F.min("rank") + 2)
    return r.groupBy("scan_id").agg(names.alias("confidence"))


@query(f"{_P} select floor(x / 0.2)::bigint + 100 * (floor(y / 0.2)::bigint + 100 * floor(z / 0.2)::bigint) as voxel, count(*) as n from points group by 1")
def voxel_hash(spark, sf_dir):
    key = spatial.cell("x", 0.2) + 100 * (spatial.cell("y", 0.2) + 100 * spatial.cell("z", 0.2))
    return room_points(spark, sf_dir).groupBy(key.alias("voxel")).agg(F.count("*").alias("n"))


@query("select page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 1) as scheme, lower(regexp_extract(url, '^(https?)://([^/?#]+)', 2)) as host, url like 'https://%' and not contains(url, '#') as safe from pages")
def origin_urls(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"), (url.startswith("https://") & ~F.contains(url, F.lit("#"))).alias("safe"))


@query("select o_orderkey as scan_id, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderdate + interval '90 minutes' as expires, date_diff('day', o_orderdate, timestamp '2000-01-01') as age from orders")
def report_dates(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.date_format(at, "yyyy-MM-dd").alias("day"), (at + F.expr("interval 90 minutes")).alias("expires"), F.date_diff(F.lit("2000-01-01").cast("date"), at.cast("date")).cast("bigint").alias("age"))


@query("select user_id as scan_id, len(list_distinct(list(event_type))) as kinds, array_to_string(list_sort(list_distinct(list(event_type))), ',') as names, round(sqrt(sum(value * value)), 6) + 0.0 as norm from events group by 1")
def array_functions(spark, sf_dir):
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scan_id")).agg(F.size(kinds).cast("bigint").alias("kinds"), F.array_join(kinds, ",").alias("names"), r6(F.sqrt(F.sum(F.col("value") * F.col("value")))).alias("norm"))


@query("select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing from events")
def json_defaults(spark, sf_dir):
    get = lambda k: F.get_json_object("props", k)
    return table(spark, sf_dir, "events").select("event_id", get("$.k").alias("k"), F.coalesce(get("$.missing"), F.lit("none")).alias("missing"))


@query()
def room_documents(spark, sf_dir):
    """Versioned JSON documents per scan, boxes in order; a document holds a run of 1,000 box ids at most."""
    items = F.sort_array(F.collect_list(F.struct("box_id", "label", r6("cx").alias("cx"), r6("cy").alias("cy"))))
    doc = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.count("*").alias("count"), items.alias("objects")))
    return room_boxes(spark, sf_dir).groupBy("scan_id", F.floor(F.col("box_id") / 1000).alias("run")).agg(doc.alias("document"))


@query()
def route_cells(spark, sf_dir):
    """Cells on a shortest way from the middle to the farthest reachable cell."""
    from habitrace.plans.graphs import _free, _seeds

    free = _free(spark, sf_dir)
    out = graph.grid_distances(free, _seeds(free), graph.FOUR)
    goal = out.groupBy("scan_id").agg(F.max(F.struct("dist", "row", "col")).alias("g")).select("scan_id", "g.row", "g.col")
    return grid.shortest_path(out, graph.grid_distances(free, goal, graph.FOUR), goal, graph.FOUR)


@query()
def adaptive_dbscan(spark, sf_dir):
    """Density clusters with a radius per label: four median nearest-neighbour gaps, clipped."""
    p = room_points(spark, sf_dir).select(F.col("label").alias("scan_id"), "point_id", "x", "y", "z")
    held = settled(density.places(p))
    eps = F.least(F.greatest(4 * F.percentile("d", 0.5, F.col("n")), F.lit(0.06)), F.lit(0.18))
    return density.clusters(p, held, density.neighbour_gaps(held, 0.18).groupBy("scan_id").agg(eps.alias("eps")), 8)
