"""Point clouds: quantiles, voxels, rasters, neighbours, projections, planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from habitrace.operators import exact, planes, spatial
from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import BOXES_SQL, POINTS_SQL, ROOM_POINTS_SQL, boxes, points, room_points, table

_P = f"with {ROOM_POINTS_SQL}"

#: Queries over whole scans, the others are by rooms.
_S = f"with {POINTS_SQL}"


def _q(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


@query(f"{_P} select scan_id, " + ", ".join(q6(f"{_q(c, 0.99)} - {_q(c, 0.01)}") + f" as extent_{c}" for c in "xyz") + " from points group by 1")
def quantile_extents(spark, sf_dir):
    q = lambda c: F.percentile(c, F.array(F.lit(0.01), F.lit(0.99)))
    return room_points(spark, sf_dir).groupBy("scan_id").agg(*(r6(q(c)[1] - q(c)[0]).alias(f"extent_{c}") for c in "xyz"))


@query(f"{_P}, m as (select scan_id, {_q('z', 0.5)} as med from points group by 1) select scan_id, {q6('any_value(med)')} as med, {q6('greatest(1.4826 * quantile_cont(abs(z - med), 0.5), 0.05)')} as mad from points join m using (scan_id) group by 1")
def mad_stats(spark, sf_dir):
    p = room_points(spark, sf_dir)
    med = p.groupBy("scan_id").agg(F.median("z").alias("med"))
    return p.join(med, "scan_id").groupBy("scan_id").agg(r6(F.first("med")).alias("med"), r6(F.greatest(1.4826 * F.median(F.abs(F.col("z") - F.col("med"))), F.lit(0.05))).alias("mad"))


_ROBUST = [("q02", 0.02), ("q10", 0.1), ("med", 0.5), ("q90", 0.9), ("q98", 0.98)]


@query("select event_type as kind, " + ", ".join(f"{q6(_q('value', p))} as {n}" for n, p in _ROBUST) + ", round(min(value), 6) + 0.0 as least, round(max(value), 6) + 0.0 as most from events group by 1")
def robust_stats(spark, sf_dir):
    qs = F.percentile("value", F.array(*(F.lit(p) for _, p in _ROBUST)))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(*(r6(qs[i]).alias(n) for i, (n, _) in enumerate(_ROBUST)), r6(F.min("value")).alias("least"), r6(F.max("value")).alias("most"))


@query(f"{_P} select label, {q6('0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))')} as angle from points group by 1")
def principal_axis(spark, sf_dir):
    return room_points(spark, sf_dir).groupBy("label").agg(r6(spatial.principal_angle("x", "y")).alias("angle"))


@query(
    f"""{_P}, m as (select label, var_pop(x) as xx, covar_pop(x, y) as xy, var_pop(y) as yy, covar_pop(x, z) as xz, covar_pop(y, z) as yz from points group by 1)
select label, {q6('sqrt(pow((xz * yy - yz * xy) / (xx * yy - xy * xy), 2) + pow((yz * xx - xz * xy) / (xx * yy - xy * xy), 2))')} as slope from m"""
)
def moment_plane_slope(spark, sf_dir):
    """Slope of the least-squares plane z = ax + by + c from second moments, one aggregation."""
    m = room_points(spark, sf_dir).groupBy("label").agg(F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"))
    c, det = F.col, F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return m.select("label", r6(F.hypot((c("xz") * c("yy") - c("yz") * c("xy")) / det, (c("yz") * c("xx") - c("xz") * c("xy")) / det)).alias("slope"))


@query(f"{_P} select scan_id, floor(x / 0.1)::bigint as vx, floor(y / 0.1)::bigint as vy, floor(z / 0.1)::bigint as vz, count(*) as n, {q6('avg(x)')} as x, {q6('avg(y)')} as y, {q6('avg(z)')} as z from points group by 1, 2, 3, 4")
def voxel_downsample(spark, sf_dir):
    return spatial.voxel_mean(room_points(spark, sf_dir), 0.1).select("scan_id", "vx", "vy", "vz", "n", *(r6(c).alias(c) for c in "xyz"))


@query(
    f"""{_P}, v as (select floor(x / 0.15)::bigint as vx, floor(y / 0.15)::bigint as vy, floor(z / 0.15)::bigint as vz, label as frame_id, scan_id as block_id, abs(z) * 40 as conf, x, row_number() over (partition by floor(x / 0.15), floor(y / 0.15), floor(z / 0.15), label order by abs(z) desc, point_id) as k from points)
select vx, vy, vz, count(*) as frames, count(distinct block_id) as blocks, {q6('max(conf)')} as best, {q6('sum(x * ln(1 + conf)) / sum(ln(1 + conf))')} as x from v where k = 1 group by 1, 2, 3
having max(conf) >= 12 or count(distinct block_id) >= 2 or count(*) >= 4"""
)
def voxel_consensus(spark, sf_dir):
    """Per frame and voxel the most confident point; kept where confidence, blocks or frames agree."""
    p = room_points(spark, sf_dir).select(*(spatial.cell(c, 0.15).alias(f"v{c}") for c in "xyz"), F.col("label").alias("frame_id"), F.col("scan_id").alias("block_id"), (F.abs("z") * 40).alias("conf"), "x", "point_id")
    best = p.groupBy("vx", "vy", "vz", "frame_id").agg(F.max_by(F.struct("conf", "x", "block_id"), F.struct("conf", (-F.col("point_id")).alias("first"))).alias("b"))
    w = F.log1p("conf")
    kept = best.select("vx", "vy", "vz", "b.*").groupBy("vx", "vy", "vz").agg(F.count("*").alias("frames"), F.countDistinct("block_id").alias("blocks"), F.max("conf").alias("best"), (F.sum(F.col("x") * w) / F.sum(w)).alias("x"))
    return kept.filter("best >= 12 or blocks >= 2 or frames >= 4").select("vx", "vy", "vz", "frames", "blocks", r6("best").alias("best"), r6("x").alias("x"))


@query(f"{_P} select distinct scan_id, floor(x / 0.05)::bigint as col, floor(y / 0.05)::bigint as row from points where z between -0.1 and 0.2")
def occupancy_grid(spark, sf_dir):
    return room_points(spark, sf_dir).filter(F.col("z").between(-0.1, 0.2)).select("scan_id", spatial.cell("x", 0.05).alias("col"), spatial.cell("y", 0.05).alias("row")).distinct()


@query(f"{_P} select scan_id, floor(x / 0.1)::bigint as col, floor(y / 0.1)::bigint as row, count(*) as n, {q6(_q('z', 0.05))} as low, {q6(_q('z', 0.85))} as high from points group by 1, 2, 3")
def height_grid(spark, sf_dir):
    q = F.percentile("z", F.array(F.lit(0.05), F.lit(0.85)))
    return room_points(spark, sf_dir).groupBy("scan_id", spatial.cell("x", 0.1).alias("col"), spatial.cell("y", 0.1).alias("row")).agg(F.count("*").alias("n"), r6(q[0]).alias("low"), r6(q[1]).alias("high"))


@query(f"{_P} select scan_id, floor(x / 0.2)::bigint as px, floor(y / 0.2)::bigint as py, {q6('max(z)')} as top, count(*) as density from points group by 1, 2, 3")
def topview_raster(spark, sf_dir):
    return room_points(spark, sf_dir).groupBy("scan_id", spatial.cell("x", 0.2).alias("px"), spatial.cell("y", 0.2).alias("py")).agg(r6(F.max("z")).alias("top"), F.count("*").alias("density"))


_SCALED = f"{_S}, {BOXES_SQL}, p as (select scan_id, point_id, x * 10 as x, y * 10 as y, z * 10 as z from points), b as (select * from boxes)"


def _inside(spark, sf_dir):
    """Every point in every box of its scan."""
    p = points(spark, sf_dir).select("scan_id", "point_id", *((F.col(c) * 10).alias(c) for c in "xyz"))
    return spatial.points_in_boxes(p, boxes(spark, sf_dir), (0.12, 0.12, 0.08), 0.5)


@query(f"{_SCALED} select p.scan_id, p.point_id, b.box_id from p join b on p.scan_id = b.scan_id and {spatial.in_obb_sql('p', 'b', 0.12, 0.12, 0.08)}")
def point_in_box(spark, sf_dir):
    return _inside(spark, sf_dir)


@query(f"{_SCALED} select b.box_id, count(*) as support from p join b on p.scan_id = b.scan_id and {spatial.in_obb_sql('p', 'b', 0.12, 0.12, 0.08)} group by 1 having count(*) >= 3")
def box_support_filter(spark, sf_dir):
    return _inside(spark, sf_dir).groupBy("box_id").agg(F.count("*").alias("support")).filter("support >= 3")


_PAIRS = "pr as (select a.scan_id, a.point_id as a, b.point_id as b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as d from points a join points b on a.scan_id = b.scan_id and a.point_id <> b.point_id)"


@query(f"{_S}, {_PAIRS} select scan_id, a, b, {q6('d')} as d from pr where d <= 0.08")
def radius_neighbors(spark, sf_dir):
    return spatial.radius_pairs(points(spark, sf_dir), 0.08).select("scan_id", "a", "b", r6("d").alias("d"))


@query(f"{_S}, {_PAIRS}, c as (select scan_id, a, count(*) as n from pr where d <= 0.12 group by 1, 2) select p.scan_id, p.point_id, coalesce(c.n, 0) >= 3 as kept from points p left join c on p.scan_id = c.scan_id and p.point_id = c.a")
def radius_outlier(spark, sf_dir):
    return spatial.with_neighbours(points(spark, sf_dir), 0.12, 3)


@query(
    f"""{_S}, {_PAIRS}, k as (select *, row_number() over (partition by scan_id, a order by d, b) as r from pr), m as (select scan_id, a, avg(d) as m from k where r <= 20 group by 1, 2),
s as (select scan_id, avg(m) + 1.6 * stddev_samp(m) as lim from m group by 1) select m.scan_id, m.a as point_id, {q6('m.m')} as mean_d, m.m > s.lim as outlier from m join s using (scan_id)"""
)
def knn_stat_outlier(spark, sf_dir):
    """Mean distance to the twenty nearest, however far, against mean + 1.6 deviations of the scan."""
    found = spatial.statistical_outliers(points(spark, sf_dir), 20, 1.6)
    return found.select("scan_id", "point_id", r6("mean_d").alias("mean_d"), "outlier")


@query(f"{_S}, g as (select a.scan_id, a.label as la, b.label as lb, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) as d from points a join points b on a.scan_id = b.scan_id and a.label < b.label group by 1, 2, 3) select scan_id, la, lb, {q6('d')} as gap from g")
def nn_gap(spark, sf_dir):
    """Least gap between two labels' point sets, however far apart."""
    return spatial.set_gaps(points(spark, sf_dir), "label", 0.1).select("scan_id", "la", "lb", r6("gap").alias("gap"))


#: A pinhole of the fixtures: R = I, t = (0, 0, 2), f = 500, c = (320, 240), 640 x 480.
_CAM = f"{_P}, c as (select scan_id, point_id, 500 * x / (z + 2) + 320 as u, 500 * y / (z + 2) + 240 as v, z + 2 as depth from points), i as (select *, floor(u / 8)::bigint as pu, floor(v / 8)::bigint as pv from c where depth > 0.1 and u >= 0 and u < 640 and v >= 0 and v < 480)"


def _projected(spark, sf_dir):
    d = F.col("z") + 2
    p = room_points(spark, sf_dir).select("scan_id", "point_id", (500 * F.col("x") / d + 320).alias("u"), (500 * F.col("y") / d + 240).alias("v"), d.alias("depth"))
    return p.filter("depth > 0.1 and u >= 0 and u < 640 and v >= 0 and v < 480").withColumn("pu", spatial.cell("u", 8)).withColumn("pv", spatial.cell("v", 8))


@query(f"{_CAM} select scan_id, point_id, {q6('u')} as u, {q6('v')} as v, {q6('depth')} as depth from i")
def pinhole_project(spark, sf_dir):
    return _projected(spark, sf_dir).select("scan_id", "point_id", *(r6(c).alias(c) for c in ("u", "v", "depth")))


@query(f"{_CAM}, n as (select *, min(depth) over (partition by scan_id, pu, pv) as near from i) select scan_id, point_id from n where depth <= near * 1.03")
def zbuffer_visible(spark, sf_dir):
    """Points within 3% of the nearest depth of their pixel."""
    near = F.min("depth").over(Window.partitionBy("scan_id", "pu", "pv"))
    return _projected(spark, sf_dir).withColumn("near", near).filter("depth <= near * 1.03").select("scan_id", "point_id")


@query(f"{_CAM} select scan_id, point_id, {q6('(u - 320) / (v - 240) * 1.5')} as gx, {q6('500 / (v - 240) * 1.5')} as gy from i where v - 240 > 1")
def ray_ground(spark, sf_dir):
    """Pixel rays below the horizon meet the ground 1.5 m under the camera; others have no hit."""
    return _projected(spark, sf_dir).filter("v - 240 > 1").select("scan_id", "point_id", r6((F.col("u") - 320) / (F.col("v") - 240) * 1.5).alias("gx"), r6(500 / (F.col("v") - 240) * 1.5).alias("gy"))


@query(f"{_CAM} select scan_id, pu, pv, max_by(point_id, {{'d': -depth, 'p': point_id}}) as front from i group by 1, 2, 3")
def painter_front(spark, sf_dir):
    return _projected(spark, sf_dir).groupBy("scan_id", "pu", "pv").agg(F.max_by("point_id", F.struct((-F.col("depth")).alias("d"), "point_id")).alias("front"))


@query(
    """with h as (select user_id as scan_id, quantile_cont(value, 0.05) as z0, count(*) as total from events group by 1), b as (select e.user_id as scan_id, floor((e.value - h.z0) / 5)::bigint as bin, count(*) as n from events e join h on h.scan_id = e.user_id where h.total >= 20 and e.value - h.z0 between 0 and 60 group by 1, 2),
k as (select *, row_number() over (partition by scan_id order by n desc, bin) as r, sum(n) over (partition by scan_id) as s from b) select scan_id, bin * 5 + 2.5 as height, n from k where r = 1 and s >= 10"""
)
def hist_step_height(spark, sf_dir):
    """The fullest fixed-width bin above the base; ties go to the lowest bin."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), "value")
    base = exact.quantiles(e, ["scan_id"], "value", {"z0": 0.05}).filter("total >= 20")
    bins = e.join(base, "scan_id").filter("value - z0 between 0 and 60").groupBy("scan_id", F.floor((F.col("value") - F.col("z0")) / 5).alias("bin")).agg(F.count("*").alias("n"))
    top = bins.groupBy("scan_id").agg(F.min_by(F.struct("bin", "n"), F.struct((-F.col("n")).alias("m"), "bin")).alias("b"), F.sum("n").alias("s")).filter("s >= 10")
    return top.select("scan_id", (F.col("b.bin") * 5 + 2.5).alias("height"), F.col("b.n").alias("n"))


@query(
    f"""{_P}, a as (select scan_id, atan2(y, x) + pi() / 2 as t from points), m as (select scan_id, floor(((t % pi()) + pi()) % pi() / (pi() / 90))::bigint as bin, count(*) as n from a group by 1, 2),
k as (select *, row_number() over (partition by scan_id order by n desc, bin) as r from m) select scan_id, bin, n from k where r = 1"""
)
def angle_mode(spark, sf_dir):
    """Mode of directions modulo pi."""
    pi = F.pi()
    bins = room_points(spark, sf_dir).groupBy("scan_id", F.floor(F.pmod(F.atan2("y", "x") + pi / 2, pi) / (pi / 90)).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("scan_id").agg(F.min_by(F.struct("bin", "n"), F.struct((-F.col("n")).alias("m"), "bin")).alias("b")).select("scan_id", "b.bin", "b.n")


@query(
    f"""{_P}, b as (select label, floor(x / 0.05)::bigint as bin, count(*) as n from points group by 1, 2), k as (select *, max(n) over (partition by label) as peak from b)
select label, {q6('min(bin) * 0.05::double')} as low, {q6('(max(bin) + 1) * 0.05::double')} as high from k where n >= greatest(peak * 0.25, 3) group by 1"""
)
def support_extents(spark, sf_dir):
    b = room_points(spark, sf_dir).groupBy("label", spatial.cell("x", 0.05).alias("bin")).agg(F.count("*").alias("n"))
    kept = b.withColumn("peak", F.max("n").over(Window.partitionBy("label"))).filter(F.col("n") >= F.greatest(F.col("peak") * 0.25, F.lit(3)))
    return kept.groupBy("label").agg(r6(F.min("bin") * 0.05).alias("low"), r6((F.max("bin") + 1) * 0.05).alias("high"))


@query(f"{_P} select scan_id, count(*) filter (where z < -0.1) as floor_points, count(*) filter (where z >= -0.1 and abs(x) > 0.2) as wall_points, count(*) filter (where z >= -0.1 and abs(x) <= 0.2) as kept from points group by 1")
def layer_removal_counts(spark, sf_dir):
    """Floor first; wall counts only what is not floor; one pass."""
    floor, wall = F.col("z") < -0.1, F.abs("x") > 0.2
    return room_points(spark, sf_dir).groupBy("scan_id").agg(F.count_if(floor).alias("floor_points"), F.count_if(~floor & wall).alias("wall_points"), F.count_if(~floor & ~wall).alias("kept"))


@query(f"{_P}, q as (select scan_id, quantile_cont(x, 0.05) as lo, quantile_cont(x, 0.95) as hi from points group by 1) select scan_id, point_id from points join q using (scan_id) where x between lo and hi")
def trim_tails(spark, sf_dir):
    p = room_points(spark, sf_dir)
    q = p.groupBy("scan_id").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return p.join(q, "scan_id").filter(F.col("x").between(F.col("q")[0], F.col("q")[1])).select("scan_id", "point_id")


@query(f"{_P}, q as (select scan_id, {_q('x', 0.99)} - {_q('x', 0.01)} as ex, {_q('y', 0.99)} - {_q('y', 0.01)} as ey, {_q('z', 0.98)} - {_q('z', 0.01)} as ez from points group by 1) select scan_id, greatest(ex, ey, ez) <= 15 and least(ex, ey, ez) >= 0.2 as metric, {q6('2.7 / ez')} as ceiling_scale from q")
def metric_sanity(spark, sf_dir):
    ext = lambda c, hi: F.percentile(c, hi) - F.percentile(c, 0.01)
    q = room_points(spark, sf_dir).groupBy("scan_id").agg(ext("x", 0.99).alias("ex"), ext("y", 0.99).alias("ey"), ext("z", 0.98).alias("ez"))
    return q.select("scan_id", ((F.greatest("ex", "ey", "ez") <= 15) & (F.least("ex", "ey", "ez") >= 0.2)).alias("metric"), r6(2.7 / F.col("ez")).alias("ceiling_scale"))


@query()
def ransac_plane(spark, sf_dir):
    """The best of 500 seeded plane hypotheses of each scan."""
    best = planes.ransac(room_points(spark, sf_dir), trials=500, threshold=0.05)
    return best.select("scan_id", "inliers", *(r6(c).alias(c) for c in ("nx", "ny", "nz")))


@query()
def min_area_rect(spark, sf_dir):
    """Footprint rectangle of least area per (scan, instance), from the exact hull."""
    return planes.min_area_rectangles(room_points(spark, sf_dir), ["scan_id", "label"])


def _similarity(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scale and angle from one scan's cross-covariance (Procrustes)."""
    r = pdf.iloc[0]
    cov = np.array(r["cov"], float).reshape(3, 3)
    u, d, vt = np.linalg.svd(cov)
    sign = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    rot = u @ sign @ vt
    return pd.DataFrame({"scan_id": [r["scan_id"]], "scale": [float((d * np.diag(sign)).sum() / r["spread"])], "angle": [float(np.arctan2(rot[1, 0], rot[0, 0]))]})


@query()
def similarity_fit(spark, sf_dir):
    """Recovers the planted transform 1.37 R(27 deg) p + t from second moments; only the 3x3 step is Python."""
    import math

    c, s = math.cos(math.radians(27)), math.sin(math.radians(27))
    p = room_points(spark, sf_dir)
    q = p.select("scan_id", "x", "y", "z", (1.37 * (c * F.col("x") - s * F.col("y")) + 0.5).alias("u"), (1.37 * (s * F.col("x") + c * F.col("y")) - 0.2).alias("v"), (1.37 * F.col("z") + 1).alias("w"))
    m = q.groupBy("scan_id").agg(F.array(*(F.covar_pop(a, b) for a in "uvw" for b in "xyz")).alias("cov"), (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread"))
    return m.groupBy("scan_id").applyInPandas(_similarity, "scan_id long, scale double, angle double")
