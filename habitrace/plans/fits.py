"""Normals, rays, rectangles and smaller fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from habitrace.operators import assignment, planes, sampling, spatial
from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import FRAMES_SQL, ROOM_BOXES_SQL, ROOM_POINTS_SQL, frames, room_boxes, room_points, table

_P = f"with {ROOM_POINTS_SQL}"
_B = f"with {ROOM_BOXES_SQL}"
_F = f"with {FRAMES_SQL}"


def _normals(spark, sf_dir):
    return planes.normals(room_points(spark, sf_dir), share=0.5)


@query()
def local_normals(spark, sf_dir):
    """A normal for each point, by PCA over at most thirty nearest; moments are aggregated in Spark, only 3x3 matrices reach Python."""
    return _normals(spark, sf_dir).select("scan_id", "point_id", "n", *(r6(c).alias(c) for c in ("nx", "ny", "nz")))


_RADIUS = "(select scan_id, quantile_cont(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)), 0.9) * 0.5 + 1e-4 as radius from points join (select scan_id, quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my, quantile_cont(z, 0.5) as mz from points group by 1) using (scan_id) group by 1)"


@query(f"{_P}, r as {_RADIUS} select a.scan_id, a.point_id, least(count(*), 30) as n from points a join points b on a.scan_id = b.scan_id join r on r.scan_id = a.scan_id where sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= greatest(radius, 0.02) group by 1, 2")
def normal_neighbourhoods(spark, sf_dir):
    """How many points each normal rests on: those within the scan's own radius, thirty at most."""
    return _normals(spark, sf_dir).select("scan_id", "point_id", "n")


@query()
def ceiling_removal(spark, sf_dir):
    """The points that stay when each scan's ceiling goes; the upper half counts as high in these clouds."""
    found = planes.without_ceiling(room_points(spark, sf_dir), top=0.6, lowest=0.5, threshold=0.03, band=0.05, upright=0.7, flat=0.6)
    return found.filter("not removed").select("scan_id", "point_id", r6("ceiling").alias("ceiling"))


@query()
def normal_direction_mode(spark, sf_dir):
    """The direction of a 10-degree sphere grid with most normals in its 15-degree cone; the first wins ties."""
    return planes.direction_mode(_normals(spark, sf_dir))


#: Four wall planes: (wall_id, axis, place).
_WALLS = [(0, "y", -2.0), (1, "x", 2.0), (2, "y", 2.0), (3, "x", -2.0)]
_W = "w(wall_id, axis, place) as (values " + ", ".join(f"({a}, '{b}', {c})" for a, b, c in _WALLS) + ")"


@query(
    f"""{_B}, {_W}, h as (select box_id, wall_id, case axis when 'x' then place / nullif(cx, 0) else place / nullif(cy, 0) end as t, axis, cx, cy, cz from boxes cross join w),
k as (select *, row_number() over (partition by box_id order by t, wall_id) as r from h where t > 0 and abs(case axis when 'x' then t * cy else t * cx end) <= 2 + 1e-9) select box_id, wall_id, {q6('t')} as t, {q6('t * cz')} as height from k where r = 1"""
)
def ray_wall_hits(spark, sf_dir):
    """Rays from the middle through box centres: the nearest wall hit inside the wall's width."""
    def hit(wall_id, axis, place):
        t = F.try_divide(F.lit(place), F.col("cx" if axis == "x" else "cy"))
        side = F.abs(t * F.col("cy" if axis == "x" else "cx")) <= 2 + 1e-9
        return F.when((t > 0) & side, F.struct(t.alias("t"), F.lit(wall_id).alias("wall_id")))

    best = F.array_min(F.array_compact(F.array(*(hit(*w) for w in _WALLS))))
    return room_boxes(spark, sf_dir).select("box_id", "cz", best.alias("b")).filter("b is not null").select("box_id", "b.wall_id", r6("b.t").alias("t"), r6(F.col("b.t") * F.col("cz")).alias("height"))


_REACH = "sqrt(sx * sx + sy * sy) / 2"


@query(f"{_B}, c as (select scan_id, box_id, unnest(range(floor((cx - {_REACH}) / 0.25)::bigint, floor((cx + {_REACH}) / 0.25)::bigint + 1)) as col, cx, cy, sx, sy, yaw from boxes), d as (select *, unnest(range(floor((cy - {_REACH}) / 0.25)::bigint, floor((cy + {_REACH}) / 0.25)::bigint + 1)) as row from c), e as (select *, (col + 0.5) * 0.25 - cx as dx, (row + 0.5) * 0.25 - cy as dy from d) select scan_id, row, col, count(*) as boxes from e where abs(cos(yaw) * dx + sin(yaw) * dy) <= sx / 2 and abs(cos(yaw) * dy - sin(yaw) * dx) <= sy / 2 group by 1, 2, 3")
def rectangle_raster(spark, sf_dir):
    """Cells whose centre lies in a turned rectangle, by how many."""
    return spatial.rasterised(room_boxes(spark, sf_dir), 0.25).groupBy("scan_id", "row", "col").agg(F.count("*").alias("boxes"))


@query(f"{_F}, t as (select *, row_number() over w as k, count(*) over (partition by scan_id) as n, lag(value, 3) over w as a3, lead(value, 3) over w as b3, first_value(value) over w as f, last_value(value) over (partition by scan_id order by ts, frame_id rows between unbounded preceding and unbounded following) as l from frames window w as (partition by scan_id order by ts, frame_id)) select scan_id, frame_id, {q6('coalesce(b3, l) - coalesce(a3, f)')} as direction from t")
def smoothed_direction(spark, sf_dir):
    """Direction over three neighbours to each side, clamped at the ends of the path."""
    w = Window.partitionBy("scan_id").orderBy("ts", "frame_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead, behind = F.coalesce(F.lead("value", 3).over(w), F.last("value").over(whole)), F.coalesce(F.lag("value", 3).over(w), F.first("value").over(whole))
    return frames(spark, sf_dir).select("scan_id", "frame_id", r6(ahead - behind).alias("direction"))


@query(f"{_F}, p as (select scan_id, frame_id, floor(max(value) over (partition by scan_id order by ts, frame_id rows unbounded preceding))::bigint as progress, ts from frames), q as (select *, lag(progress) over (partition by scan_id order by ts, frame_id) as before from p) select scan_id, frame_id, progress from q where before is null or progress > before")
def progress_steps(spark, sf_dir):
    """Progress that never goes back; only rows that move it by a whole step."""
    w = Window.partitionBy("scan_id").orderBy("ts", "frame_id")
    p = frames(spark, sf_dir).select("scan_id", "frame_id", "ts", F.floor(F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("progress"))
    return p.withColumn("before", F.lag("progress").over(w)).filter("before is null or progress > before").select("scan_id", "frame_id", "progress")


@query(f"{_P}, k as (select *, row_number() over (partition by scan_id order by point_id) - 1 as k, count(*) over (partition by scan_id) as n from points) select scan_id, point_id from k where n <= 1200 or exists (select 1 from (select unnest(range(0, 1200)) as i) where floor(i * (n - 1) / 1199.0) = k)")
def uniform_index_sample(spark, sf_dir):
    """1,200 evenly spaced points of each larger scan."""
    return sampling.evenly_spaced(room_points(spark, sf_dir), ["scan_id"], ["point_id"], 1200).select("scan_id", "point_id")


@query(f"{_F}, k as (select *, row_number() over (partition by scan_id order by ts, frame_id) - 1 as k, count(*) over (partition by scan_id) as n from frames) select scan_id, frame_id from k where n <= 30 or exists (select 1 from (select unnest(range(0, 30)) as i) where floor(i * (n - 1) / 29.0) = k)")
def phase_image_sample(spark, sf_dir):
    """Thirty evenly spaced images of each phase that has more."""
    return sampling.evenly_spaced(frames(spark, sf_dir), ["scan_id"], ["ts", "frame_id"], 30).select("scan_id", "frame_id")


@query(f"{_B} select box_id, greatest(cx - sx / 2, -2.0) as x0, least(cx + sx / 2, 2.0) as x1, greatest(cx - sx / 2, -2.0) < least(cx + sx / 2, 2.0) as valid from boxes")
def detection_clamp(spark, sf_dir):
    x0, x1 = F.greatest(F.col("cx") - F.col("sx") / 2, F.lit(-2.0)), F.least(F.col("cx") + F.col("sx") / 2, F.lit(2.0))
    return room_boxes(spark, sf_dir).select("box_id", x0.alias("x0"), x1.alias("x1"), (x0 < x1).alias("valid"))


@query(f"{_P} select label, count(*) as n, count(*) filter (where case when label in (1, 2) then z > 0.1 when label = 3 then z > -0.05 else true end) as kept from points group by 1")
def class_height_filter(spark, sf_dir):
    keep = F.when(F.col("label").isin(1, 2), F.col("z") > 0.1).when(F.col("label") == 3, F.col("z") > -0.05).otherwise(F.lit(True))
    return room_points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(keep).alias("kept"))


@query(
    f"""{_P}, c as (select distinct scan_id, floor(x / 0.05)::bigint as bin from points where z < -0.05), i as (select *, bin - row_number() over (partition by scan_id order by bin) as g from c),
r as (select scan_id, g, min(bin) as b0, max(bin) as b1 from i group by 1, 2 having count(*) >= 4), t as (select distinct scan_id, floor(x / 0.05)::bigint as bin from points where z > 0.25)
select r.scan_id, r.b0, r.b1 from r where not exists (select 1 from t where t.scan_id = r.scan_id and t.bin between r.b0 and r.b1)"""
)
def low_wall_strip(spark, sf_dir):
    """Connected runs of low cells at a wall, long enough, with no taller cell in them."""
    p = room_points(spark, sf_dir)
    c = p.filter("z < -0.05").select("scan_id", spatial.cell("x", 0.05).alias("bin")).distinct()
    g = F.col("bin") - F.row_number().over(Window.partitionBy("scan_id").orderBy("bin"))
    runs = c.withColumn("g", g).groupBy("scan_id", "g").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.count("*").alias("n")).filter("n >= 4")
    tall = p.filter("z > 0.25").select("scan_id", spatial.cell("x", 0.05).alias("bin")).distinct()
    crossed = runs.select("scan_id", "b0", F.explode(F.sequence("b0", "b1")).alias("bin")).join(tall, ["scan_id", "bin"], "left_semi").select("scan_id", "b0").distinct()
    return runs.join(crossed, ["scan_id", "b0"], "left_anti").select("scan_id", "b0", "b1")


@query(f"{_F}, s as (select scan_id, kind, count(distinct view_id) as v from frames group by 1, 2), c as (select a.scan_id, a.kind, max(case when b.kind < a.kind then b.v end) as compatible, max(case when b.kind > a.kind then b.v end) as conflicting from s a join s b using (scan_id) group by 1, 2) select * from c")
def candidate_evidence(spark, sf_dir):
    """Greatest compatible and conflicting evidence around each component; five kinds per scan at most."""
    s = frames(spark, sf_dir).groupBy("scan_id", "kind").agg(F.countDistinct("view_id").alias("v"))
    a, b = s.select("scan_id", "kind"), s.select("scan_id", F.col("kind").alias("other"), "v")
    return a.join(b, "scan_id").groupBy("scan_id", "kind").agg(F.max(F.when(F.col("other") < F.col("kind"), F.col("v"))).alias("compatible"), F.max(F.when(F.col("other") > F.col("kind"), F.col("v"))).alias("conflicting"))


@query("select l_orderkey as scan_id, l_linenumber as object_id, l_partkey as part_id, p_name as name, abs(l_quantity / 50 - p_size / 50.0) / nullif(p_size / 50.0, 0) > 0.5 as off from lineitem join part on l_partkey = p_partkey where l_returnflag = 'N'")
def validation_references(spark, sf_dir):
    """References that only validate: an error flag per row, nothing is changed."""
    known = F.col("p_size") / 50.0
    l, p = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'"), table(spark, sf_dir, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"), F.col("l_partkey").alias("part_id"), F.col("p_name").alias("name"), (F.try_divide(F.abs(F.col("l_quantity") / 50 - known), known) > 0.5).alias("off"))


@query()
def track_assignment(spark, sf_dir):
    """Instances (even boxes) of a scan and kind to its tracks (odd boxes), at the least total distance."""
    b = room_boxes(spark, sf_dir).select("scan_id", F.col("label").alias("kind"), "box_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    instances = b.filter("box_id % 2 = 0").withColumnRenamed("box_id", "instance_id")
    tracks = b.filter("box_id % 2 = 1").withColumnRenamed("box_id", "track_id")
    return assignment.assign(instances, tracks, ["scan_id", "kind"])


def _directions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy clusters of unit directions, strongest first: |dot| >= 0.9 joins the first that fits."""
    pdf = pdf.sort_values(["n", "gx", "gy", "gz"], ascending=[False, True, True, True])
    v = pdf[["nx", "ny", "nz"]].to_numpy(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    heads: list[int] = []
    own = []
    for i in range(len(v)):
        fit = next((k for k, h in enumerate(heads) if abs(v[i] @ v[h]) >= 0.9), None)
        if fit is None:
            heads.append(i)
            fit = len(heads) - 1
        own.append(fit)
    weight = pdf.groupby(np.array(own))["n"].sum()
    return pd.DataFrame({"scan_id": pdf.scan_id.iloc[0], "cluster": weight.index.astype(np.int64), "n": weight.to_numpy(np.int64), **{c: v[heads, i] for i, c in enumerate(("nx", "ny", "nz"))}})


@query()
def direction_clusters(spark, sf_dir):
    """Main directions per scan; normals are first counted on a grid of at most 729 cells, so a group is small."""
    g = [F.round(F.col(c) * 4).cast("int").alias(f"g{c[1]}") for c in ("nx", "ny", "nz")]
    cells = _normals(spark, sf_dir).groupBy("scan_id", *g).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("nx", "ny", "nz")))
    return cells.groupBy("scan_id").applyInPandas(_directions, "scan_id long, cluster long, n long, nx double, ny double, nz double")


_COR = ["c.cx + (cos(c.yaw) * {a} * c.sx - sin(c.yaw) * {b} * c.sy) / 2", "c.cy + (sin(c.yaw) * {a} * c.sx + cos(c.yaw) * {b} * c.sy) / 2"]


@query(f"{_B}, k(i, a, b) as (values (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) select c.box_id, k.i as corner, {q6(_COR[0].format(a='k.a', b='k.b'))} as x, {q6(_COR[1].format(a='k.a', b='k.b'))} as y from boxes c cross join k")
def rectangle_corners(spark, sf_dir):
    """Corners of each turned footprint."""
    c, s, hx, hy = F.cos("yaw"), F.sin("yaw"), F.col("sx") / 2, F.col("sy") / 2
    corner = lambda i, a, b: F.struct(F.lit(i).alias("corner"), r6(F.col("cx") + c * (a * hx) - s * (b * hy)).alias("x"), r6(F.col("cy") + s * (a * hx) + c * (b * hy)).alias("y"))
    return room_boxes(spark, sf_dir).select("box_id", F.explode(F.array(*(corner(i, a, b) for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))))).alias("k")).select("box_id", "k.*")
