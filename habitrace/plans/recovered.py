"""Cameras recovered from pixels, splats for viewers, low strips at walls."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import poses, splats, strips
from habitrace.plans.define import q6, query, r6
from habitrace.plans.rooms import _P, _metric
from habitrace.sources.driver_tables import ROOM_POINTS_SQL, room_points

MOST = 12


def _seen(spark, sf_dir):
    """Every scan's points before three cameras, one pixel in six at a wrong place; the third camera's pixels are mostly wrong."""
    p = _metric(spark, sf_dir).select("scan_id", "point_id", *"xyz").withColumn("frame_id", F.explode(F.sequence(*(F.lit(k).cast("long") for k in (0, 2)))))
    angle = 0.1 * F.col("frame_id") + F.pmod(F.col("scan_id"), F.lit(7)) * 0.05
    cam = {"cu": F.cos(angle) * F.col("x") + F.sin(angle) * F.col("z") + 0.1, "cv": F.col("y") - 0.05, "cw": F.cos(angle) * F.col("z") - F.sin(angle) * F.col("x") + 12}
    draw = lambda k, n: F.pmod(F.xxhash64("point_id", "frame_id", F.lit(k)), F.lit(n)).cast("double")
    wrong = draw(1, 6) < 1 + 4 * F.floor(F.col("frame_id") / 2)
    pixel = lambda c, k: F.when(wrong, draw(k, 224)).otherwise(112 + 280 * F.col(c) / F.col("cw") + (draw(k, 101) - 50) / 100)
    return p.withColumns(cam).select("scan_id", "frame_id", "point_id", pixel("cu", 2).alias("u"), pixel("cv", 3).alias("v"), *"xyz", (draw(4, 20) + 11).alias("conf"))


@query()
def frame_poses(spark, sf_dir):
    """Which frames get a pose, by four-pixel draws and refinement; scans have a hundred points, so a frame needs fifty."""
    found = poses.frame_poses(_seen(spark, sf_dir), least_points=50, least_inliers=40, trials=60)
    return found.select("scan_id", "frame_id", "points", "inliers", F.round("error", 1).alias("error"), "accepted", "reason")


#: A frame's record, a frame for each vector: quality, gates and a pose turned around z.
_FRAMES = f"with {ROOM_POINTS_SQL}, f as (select scan_id, point_id as frame_id, 300 + 900 * x as focal, 800 + point_id * 37 % 900 as inliers, abs(y) * 10 as error, abs(z) * 1000 as sharpness, case when point_id % 9 = 4 then 'few_inliers' when abs(y) * 10 > 2.5 then 'reprojection' end as reason, x, y, z from points)"


def _frames(spark, sf_dir):
    p, error = room_points(spark, sf_dir), F.abs("y") * 10
    reason = F.when(F.col("point_id") % 9 == 4, "few_inliers").when(error > 2.5, "reprojection")
    told = p.select("scan_id", F.col("point_id").alias("frame_id"), (300 + 900 * F.col("x")).alias("focal"), (800 + F.col("point_id") * 37 % 900).alias("inliers"), error.alias("error"), (F.abs("z") * 1000).alias("sharpness"), reason.alias("reason"), *"xyz")
    return told.withColumn("accepted", F.col("reason").isNull())


@query(f"{_FRAMES} select scan_id, count(*) filter (reason is null or reason = 'reprojection') as frames, case when frames >= 30 then {q6('least(greatest(quantile_cont(focal, 0.5) filter (reason is null or reason = $$reprojection$$), 200), 420)')} end as focal from f group by 1".replace("$$reprojection$$", "'reprojection'"))
def common_focal(spark, sf_dir):
    """The focal length that a scan's frames agree on."""
    return poses.common_focal(_frames(spark, sf_dir)).withColumn("focal", r6("focal"))


_SPREAD = f"""k as (select *, row_number() over (partition by scan_id order by frame_id) - 1 as pos, count(*) over (partition by scan_id) as n, 0.25 * ln(1 + sharpness) + 0.15 * ln(1 + inliers) - error as quality from f where reason is null),
s as (select *, case when n <= {MOST} then pos else ceil((pos + 1) / (n / {MOST})) - 1 end as stretch from k), b as (select *, row_number() over (partition by scan_id, stretch order by quality desc, frame_id) = 1 as best from s),
c as (select scan_id, frame_id, case when best then 'primary' else 'backup' end as role, row_number() over (partition by scan_id, best order by case when best then null else quality end desc nulls last, frame_id) as rank from b)"""


@query(f"{_FRAMES}, {_SPREAD} select * from c")
def frames_over_time(spark, sf_dir):
    """One frame of each stretch of a scan, and the order in which others stand in; twelve places as scans have a hundred frames."""
    return poses.spread_over_time(_frames(spark, sf_dir), MOST)


_TURN = ["1", "0", "0", "0", "cos(a)", "-sin(a)", "0", "sin(a)", "cos(a)"]
_OWN = ["cos(r)", "-sin(r)", "0", "sin(r)", "cos(r)", "0", "0", "0", "1"]
_PLACE = [" + ".join(f"({_TURN[3 * i + k]}) * ({' + '.join(f'({_OWN[3 * m + k]}) * {c}' for m, c in enumerate('xyz'))})" for k in range(3)) for i in range(3)]
_LOOK = [" + ".join(f"({_OWN[6 + k]}) * ({_TURN[3 * j + k]})" for k in range(3)) for j in range(3)]


@query(
    f"""{_FRAMES}, {_SPREAD}, g as (select f.*, f.frame_id * 0.01 as r, f.scan_id % 10 * 0.1 as a, row_number() over (partition by f.scan_id order by role desc, rank) as place from f join c using (scan_id, frame_id) where f.frame_id % 5 <> 2)
select scan_id, frame_id, {q6(f"-1.5 * ({_PLACE[0]})")} as px, {q6(f"-1.5 * ({_PLACE[1]})")} as py, {q6(f"-1.5 * ({_PLACE[2]} + 0.2)")} as pz, {q6(_LOOK[1])} as look_y, {q6(_LOOK[2])} as look_z
from (select *, count(*) over (partition by scan_id) as n from g where place <= {MOST}) where n >= 5"""
)
def recovered_cameras(spark, sf_dir):
    """Cameras in aligned metres: frames that a second pass rejects are replaced by the best backups."""
    angle, a = F.col("frame_id") * 0.01, F.pmod(F.col("scan_id"), F.lit(10)) * 0.1
    own = F.array(F.cos(angle), -F.sin(angle), F.lit(0.0), F.sin(angle), F.cos(angle), *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))
    first = _frames(spark, sf_dir)
    second = first.select("scan_id", "frame_id", "focal", "inliers", "error", own.alias("rotation"), F.array(*"xyz").alias("shift"), (F.col("frame_id") % 5 != 2).alias("accepted"))
    turn = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)), F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a))
    aligned = first.select("scan_id").distinct().select("scan_id", turn.alias("turn"), F.lit(1.5).alias("scale"), F.lit(0.2).alias("floor"))
    found = poses.cameras(second, poses.spread_over_time(first, MOST), aligned, MOST, 5)
    at, look = F.col("position"), F.col("rotation")
    return found.select("scan_id", "frame_id", *(r6(at[k]).alias(f"p{c}") for k, c in enumerate("xyz")), r6(look[7]).alias("look_y"), r6(look[8]).alias("look_z"))


_E = lambda k: f"embedding[{k + 1}]::double"
#: A splat for each vector; some scales are below the least, some opacities and colours beyond their range, one rotation in eleven is of zeros.
_SPLATS = (
    "with s as (select vec_id // 100 as scan_id, vec_id as splat_id, "
    + ", ".join(f"{_E(k)} as {c}" for k, c in enumerate("xyz"))
    + ", "
    + ", ".join(f"{_E(3 + k)} as scale_{k}" for k in range(3))
    + f", {_E(6)} * 5 + 0.5 as opacity, "
    + ", ".join(f"case when vec_id % 11 = 3 then 0 else {_E(7 + k)} end as rot_{k}" for k in range(4))
    + ", "
    + ", ".join(f"{_E(11 + k)} * 5 + 0.5 as f_dc_{k}" for k in range(3))
    + " from embeddings)"
)


def _splats(spark, sf_dir):
    from habitrace.sources.driver_tables import table

    e = lambda k: F.col("embedding")[k].cast("double")
    turn = [F.when(F.col("vec_id") % 11 == 3, 0.0).otherwise(e(7 + k)).alias(f"rot_{k}") for k in range(4)]
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 100).alias("scan_id"), F.col("vec_id").alias("splat_id"), *(e(k).alias(c) for k, c in enumerate("xyz")), *(e(3 + k).alias(f"scale_{k}") for k in range(3)), (e(6) * 5 + 0.5).alias("opacity"), *turn, *((e(11 + k) * 5 + 0.5).alias(f"f_dc_{k}") for k in range(3)),
    )


@query(
    f"{_SPLATS} select scan_id, splat_id, x, "
    + ", ".join(f"{q6(f'ln(greatest(scale_{k}, 1e-12))')} as scale_{k}" for k in range(3))
    + f", {q6('ln(least(greatest(opacity, 1e-6), 1 - 1e-6) / (1 - least(greatest(opacity, 1e-6), 1 - 1e-6)))')} as opacity, rot_1 as rot_0, rot_2 as rot_1, rot_3 as rot_2, rot_0 as rot_3, f_dc_0 from s"
)
def splat_parameters(spark, sf_dir):
    """Splats as the web's viewers hold them: logarithms, log odds, rotations with w last."""
    made = splats.web_parameters(_splats(spark, sf_dir))
    return made.select("scan_id", "splat_id", "x", *(r6(f"scale_{k}").alias(f"scale_{k}") for k in range(3)), r6("opacity").alias("opacity"), *(f"rot_{k}" for k in range(4)), "f_dc_0")


_BYTE = lambda v: f"floor(least(greatest({v}, 0), 255))::int"


@query(
    f"{_SPLATS}, n as (select *, greatest(sqrt(rot_0 * rot_0 + rot_1 * rot_1 + rot_2 * rot_2 + rot_3 * rot_3), 1e-12) as size, row_number() over (partition by scan_id order by splat_id) - 1 as place from s) select scan_id, place, "
    + ", ".join(f"{c}::float as {c}" for c in ("x", "y", "z", "scale_0", "scale_1", "scale_2"))
    + ", "
    + ", ".join(f"{_BYTE(f'{c} * 255')} as {n}" for n, c in zip(("red", "green", "blue", "alpha"), ("f_dc_0", "f_dc_1", "f_dc_2", "opacity")))
    + ", "
    + ", ".join(f"{_BYTE(f'rot_{k} / size * 128 + 128')} as turn_{c}" for k, c in enumerate("wxyz"))
    + " from n"
)
def splat_records(spark, sf_dir):
    """Records of 32 bytes, written as files of a scan's parts and read again."""
    return splats.round_trip(_splats(spark, sf_dir), part=1000)


_STRIP = {"far": 1.2, "top": 2.6, "length": 0.8, "span": 0.05, "start": 0.9, "cell": 0.4, "least": 5, "stay": 93}


@query(
    _P
    + ", r as (select scan_id, quantile_cont(x, 0.05) as lo_x, quantile_cont(x, 0.95) as hi_x, quantile_cont(y, 0.05) as lo_y, quantile_cont(y, 0.95) as hi_y from p group by 1),"
    + "a as ("
    + " union all ".join(f"select scan_id, point_id, z, {w} as wall, {d} as depth, floor({c} / {_STRIP['cell']}) as bin from p join r using (scan_id)" for w, (d, c) in enumerate((("x - lo_x", "y"), ("hi_x - x", "y"), ("y - lo_y", "x"), ("hi_y - y", "x"))))
    + f"""), b as (select *, depth between 0.03 and {_STRIP['far']} and z <= {_STRIP['top']} as band from a),
c as (select scan_id, wall, bin, max(z) as highest, count(*) filter (band) as n, min(z) filter (band) as z0, max(z) filter (band) as z1 from b group by all),
w as (select *, sum(n) over (partition by scan_id, wall) as every from c),
l as (select *, bin - row_number() over (partition by scan_id, wall order by bin) as run from w where every >= {_STRIP['least']} and n > 0 and highest <= {_STRIP['top']} + 0.05 and z1 - z0 >= {_STRIP['span']} and z0 <= {_STRIP['start']}),
g as (select *, count(*) over (partition by scan_id, wall, run) as cells from l),
gone as (select distinct scan_id, point_id from b join (select scan_id, wall, bin from g where cells * {_STRIP['cell']} >= {_STRIP['length']}) using (scan_id, wall, bin) where band),
m as (select p.scan_id, p.point_id, gone.point_id is not null as strip from p left join gone using (scan_id, point_id)),
k as (select scan_id from m group by 1 having count(*) filter (not strip) < greatest({_STRIP['stay']}, floor(count(*) * 0.25)))
select scan_id, count(*) as n, count(*) filter (not strip or scan_id in (select scan_id from k)) as kept from m group by 1"""
)
def wall_strips(spark, sf_dir):
    """Points of each scan before and after low strips at its four walls are taken out; wide cells as the clouds are sparse."""
    p = _metric(spark, sf_dir)
    q = lambda c, v: F.percentile(c, v)
    rooms = p.groupBy("scan_id").agg(q("x", 0.05).alias("lo_x"), q("x", 0.95).alias("hi_x"), q("y", 0.05).alias("lo_y"), q("y", 0.95).alias("hi_y"))
    kept = strips.without_wall_strips(p, rooms, **_STRIP).groupBy("scan_id").agg(F.count("*").alias("kept"))
    return p.groupBy("scan_id").agg(F.count("*").alias("n")).join(kept, "scan_id", "left").select("scan_id", "n", F.coalesce("kept", F.lit(0)).alias("kept"))
