"""Tracks, fragments and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import graph, pairs, spatial, tracks
from habitrace.plans.clouds import _CAM, _projected
from habitrace.plans.define import q6, query, r6
from habitrace.plans.graphs import _E, _near
from habitrace.sources.driver_tables import ROOM_POINTS_SQL, room_boxes, room_points, table

#: Scans are fifteen users each. Observations: runs of 150 events, two a frame, per scan and kind; what they project to are view numbers.
_OBS = "b as (select distinct user_id // 15 as scan_id, event_type as grp, event_id // 150 as obs_id, cast(json_extract_string(props, '$.k') as bigint) as point_id from events), o as (select distinct scan_id, grp, obs_id, obs_id // 2 as frame_id, obs_id // 2 as frame_order from b)"


def _bridge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("user_id") / 15).alias("scan_id"), F.col("event_type").alias("grp"), F.floor(F.col("event_id") / 150).alias("obs_id"), F.get_json_object("props", "$.k").cast("bigint").alias("point_id")).distinct()


def _observations(bridge):
    half = F.floor(F.col("obs_id") / 2)
    return bridge.select("scan_id", "grp", "obs_id").distinct().withColumns({"frame_id": half, "frame_order": half})


@query(
    f"""with {_OBS}, n as (select scan_id, grp, obs_id, count(*) as n from b group by 1, 2, 3), m as (select scan_id, grp, count(*) as members from o group by 1, 2),
s as (select l.scan_id, l.grp, l.obs_id as a, r.obs_id as b, count(*) as shared from b l join b r on l.scan_id = r.scan_id and l.grp = r.grp and l.point_id = r.point_id and l.obs_id < r.obs_id group by all
 union all select l.scan_id, l.grp, l.obs_id, r.obs_id, 0 from o l join o r on l.scan_id = r.scan_id and l.grp = r.grp and l.frame_id = r.frame_id and l.obs_id < r.obs_id),
p as (select scan_id, grp, a, b, max(shared) as shared from s group by all),
j as (select p.*, shared / greatest(least(x.n, y.n), 1) as overlap, abs(p.a // 2 - p.b // 2) as gap, p.a // 2 = p.b // 2 as same, greatest(3.0, ceil(0.15 * members)) as continuity from p join n x on x.scan_id = p.scan_id and x.grp = p.grp and x.obs_id = p.a join n y on y.scan_id = p.scan_id and y.grp = p.grp and y.obs_id = p.b join m on m.scan_id = p.scan_id and m.grp = p.grp)
select scan_id, grp, a, b, shared, same and overlap < 0.02 as conflict, not same and shared >= 3 and overlap >= 0.03 as accepted, {q6("0.55 * least(overlap / 0.25, 1) + 0.2 * greatest(0, 1 - gap / continuity)")} as score from j"""
)
def pair_evidence(spark, sf_dir):
    """What speaks for and against two observations being one thing."""
    b = _bridge(spark, sf_dir)
    e = tracks.pair_evidence(_observations(b), b, ["scan_id", "grp"])
    return e.select("scan_id", "grp", "a", "b", "shared", "conflict", "accepted", r6("score").alias("score"))


@query()
def greedy_tracks(spark, sf_dir):
    """Observations to tracks, best evidence first, never two that conflict."""
    b = _bridge(spark, sf_dir)
    o = _observations(b)
    return tracks.associate(o, tracks.pair_evidence(o, b, ["scan_id", "grp"]), ["scan_id", "grp"])


_MASKS = "m as (select scan_id, point_id // 5 % 5 as mask, point_id % 2 as view, point_id from points), h as (select p.scan_id, p.label as fragment, m.mask, count(*) as hits from points p join m on m.scan_id = p.scan_id and m.point_id = p.point_id group by 1, 2, 3), z as (select scan_id, label as fragment, count(*) as size from points group by 1, 2)"
_WALK = "r as (select distinct scan_id, label as node, label as lab from points union select r.scan_id, case when e.a = r.node then e.b else e.a end, r.lab from r join e on e.scan_id = r.scan_id and (e.a = r.node or e.b = r.node)) select scan_id, node as fragment, min(lab) as merged from r group by 1, 2"


def _fragments(spark, sf_dir):
    p = room_points(spark, sf_dir)
    f = p.select("scan_id", F.col("label").alias("fragment"), "point_id", "x", "y", "z")
    return f, p.select("scan_id", (F.floor(F.col("point_id") / 5) % 5).alias("mask"), (F.col("point_id") % 2).alias("view"), "point_id")


@query(
    f"""with recursive {ROOM_POINTS_SQL}, {_MASKS}, c as (select scan_id, fragment, mask from h where hits >= 3), s as (select l.scan_id, l.fragment as a, r.fragment as b from c l join c r on l.scan_id = r.scan_id and l.mask = r.mask and l.fragment < r.fragment group by 1, 2, 3 having count(*) >= 2),
g as (select a.scan_id, a.label as a, b.label as b from points a join points b on a.scan_id = b.scan_id and a.label < b.label group by 1, 2, 3 having min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) <= 0.125), e as (select s.* from s join g on g.scan_id = s.scan_id and g.a = s.a and g.b = s.b), {_WALK}"""
)
def fragment_merge(spark, sf_dir):
    """Fragments that share two masks and are near belong together."""
    f, m = _fragments(spark, sf_dir)
    return tracks.merge_by_masks(f, m.drop("view"), 0.05)


@query(
    f"""with recursive {ROOM_POINTS_SQL}, {_MASKS}, c as (select h.scan_id, h.fragment, h.mask from h join z on z.scan_id = h.scan_id and z.fragment = h.fragment where hits >= greatest(4, floor(0.25 * size))),
e as (select distinct l.scan_id, l.fragment as a, r.fragment as b from c l join c r on l.scan_id = r.scan_id and l.mask = r.mask and l.fragment < r.fragment), {_WALK}"""
)
def same_mask_merge(spark, sf_dir):
    """Fragments that one mask covers to a quarter and by four points each belong together."""
    f, m = _fragments(spark, sf_dir)
    return tracks.merge_by_same_mask(f, m.drop("view"))


@query()
def track_fragment_merge(spark, sf_dir):
    """Fragments joined by repeated views, unless their spatial candidates are of different groups."""
    f, m = _fragments(spark, sf_dir)
    m = m.withColumn("mask", F.col("mask") * 2 + F.col("view"))
    groups = f.select("scan_id", "fragment").distinct().withColumn("grp", F.when(F.col("fragment") % 4 == 0, "bed").when(F.col("fragment") % 4 == 1, "desk"))
    return tracks.merge_tracks(f, m, groups, "bed", 0.05, 2)


@query(
    f"""with recursive {ROOM_POINTS_SQL}, e as (select a.scan_id, a.point_id as a, b.point_id as b from points a join points b on a.scan_id = b.scan_id and a.point_id <> b.point_id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.1),
s as (select scan_id, min(point_id) as node from points where label = 3 group by 1), r as (select scan_id, node from s union select r.scan_id, e.b from r join e on e.scan_id = r.scan_id and e.a = r.node) select scan_id, node as point_id from r"""
)
def seeded_region(spark, sf_dir):
    """Points that a seed reaches in steps of at most 0.1: what a candidate box is augmented by."""
    p = room_points(spark, sf_dir)
    seeds = p.filter("label = 3").groupBy(F.col("scan_id").alias("scope")).agg(F.min("point_id").alias("node"))
    edges = spatial.radius_pairs(p, 0.1).select(F.col("scan_id").alias("scope"), "a", "b")
    return graph.reachable(seeds, edges).select(F.col("scope").alias("scan_id"), F.col("node").alias("point_id"))


@query()
def complete_link_clusters(spark, sf_dir):
    """Detections of one kind in one room, by complete link at 0.48."""
    b = room_boxes(spark, sf_dir).select("scan_id", F.col("label").alias("kind"), F.col("box_id").alias("row_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return tracks.link_clusters(b, ["scan_id", "kind"])


@query(
    f"""with recursive {ROOM_POINTS_SQL}, d as (select a.scan_id, a.point_id as a, b.point_id as b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) as d from points a join points b on a.scan_id = b.scan_id and a.point_id <> b.point_id),
f as (select scan_id, a, max(d) as d from (select *, row_number() over (partition by scan_id, a order by d, b) as k from d) where k <= 4 group by 1, 2), q as (select scan_id, greatest(quantile_cont(d, 0.25) * 3, 1e-5) as radius from f group by 1),
e as (select d.scan_id, d.a, d.b from d join q using (scan_id) where d.d <= radius), r as (select scan_id, point_id as node, point_id as lab from points union select r.scan_id, e.b, r.lab from r join e on e.scan_id = r.scan_id and e.a = r.node)
select scan_id, component, count(*) as size from (select scan_id, node, min(lab) as component from r group by 1, 2) group by 1, 2"""
)
def dense_cores(spark, sf_dir):
    """Components by a radius from the dense quarter of the points."""
    found = tracks.dense_components(room_points(spark, sf_dir))
    return found.groupBy("scan_id", "component").agg(F.count("*").alias("size"))


@query(
    f"""with recursive {_E}, c as (select scan_id, a as node from e group by 1, 2 having count(*) + 1 >= 4), ce as (select e.* from e join c x on x.scan_id = e.scan_id and x.node = e.a join c y on y.scan_id = e.scan_id and y.node = e.b),
r as (select scan_id, node, node as lab from c union select r.scan_id, ce.b, r.lab from r join ce on ce.scan_id = r.scan_id and ce.a = r.node), k as (select scan_id, node, min(lab) as cluster from r group by 1, 2),
b as (select e.scan_id, e.a as node, min(k.cluster) as beside from e join k on k.scan_id = e.scan_id and k.node = e.b group by 1, 2),
l as (select p.scan_id, coalesce(k.cluster, b.beside) as cluster from points p left join k on k.scan_id = p.scan_id and k.node = p.point_id left join b on b.scan_id = p.scan_id and b.node = p.point_id),
n as (select scan_id, cluster, count(*) as n from l where cluster is not null group by 1, 2) select scan_id, max_by(cluster, {{'n': n, 'c': -cluster}}) as cluster, max(n) as n from n group by 1"""
)
def largest_cluster(spark, sf_dir):
    """The largest density cluster of each scan."""
    return tracks.largest(graph.dbscan(room_points(spark, sf_dir), _near(spark, sf_dir), 4))


@query()
def footprint_exclusion(spark, sf_dir):
    """Points around each object without those in the footprints of larger objects before it."""
    b = room_boxes(spark, sf_dir).filter("label in (0, 1, 2)")
    objects = b.select("scan_id", F.col("box_id").alias("object_id"), F.col("box_id").alias("rank"), "cx", "cy", (F.col("sx") * 4).alias("sx"), (F.col("sy") * 4).alias("sy"), "yaw")
    p = room_points(spark, sf_dir).select("scan_id", "point_id", (F.col("x") * 10).alias("x"), (F.col("y") * 10).alias("y"), (F.col("z") * 10).alias("z"))
    wide = b.withColumns({"sx": F.col("sx") * 6, "sy": F.col("sy") * 6, "sz": F.lit(20.0)})
    own = spatial.points_in_boxes(p, wide, (0.0, 0.0, 0.0), 1.0).withColumnRenamed("box_id", "object_id").join(p, ["scan_id", "point_id"])
    return tracks.exclude_footprints(own, objects, 0.10, 5)


@query(f"{_CAM.replace('select scan_id, point_id, 500', 'select scan_id, point_id, label, 500')}, d as (select i.*, case when pu % 2 = 0 then 'left' else 'right' end as detection from i where label = 2), n as (select *, min(depth) over (partition by scan_id, detection, pu, pv) as near from d) select scan_id, detection, point_id from n where depth - near <= 0.03")
def detection_hits(spark, sf_dir):
    """Points of one label that a detection's mask sees: the nearest surface of each pixel, 3 cm deep."""
    from pyspark.sql import Window

    shown = _projected(spark, sf_dir).join(room_points(spark, sf_dir).filter("label = 2").select("scan_id", "point_id"), ["scan_id", "point_id"])
    d = shown.withColumn("detection", F.when(F.col("pu") % 2 == 0, "left").otherwise("right"))
    near = F.min("depth").over(Window.partitionBy("scan_id", "detection", "pu", "pv"))
    return d.withColumn("near", near).filter("depth - near <= 0.03").select("scan_id", "detection", "point_id")


#: Twenty-five observations a scan in two groups: four points each and the first one or three of the observation two further; four observations make a frame.
_MASKS = f"""with {ROOM_POINTS_SQL}, i as (select *, point_id % 100 as k, point_id % 100 // 4 as own from points),
b as (select scan_id, own % 2 as grp, own as obs_id, point_id from i union all select scan_id, own % 2, own - 2, point_id from i where own >= 2 and k % 4 < case when own % 3 = 0 then 3 else 1 end),
o as (select distinct scan_id, grp, obs_id, obs_id // 4 as frame_id, obs_id // 4 * 2 as frame_order from b)"""


def _masks(spark, sf_dir):
    p = room_points(spark, sf_dir).withColumns({"k": F.col("point_id") % 100, "own": F.floor(F.col("point_id") % 100 / 4)})
    row = lambda obs: [F.col("scan_id"), (F.col("own") % 2).alias("grp"), obs.alias("obs_id"), F.col("point_id")]
    more = p.filter((F.col("own") >= 2) & (F.col("k") % 4 < F.when(F.col("own") % 3 == 0, 3).otherwise(1)))
    return p, p.select(*row(F.col("own"))).union(more.select(*row(F.col("own") - 2)))


@query(
    f"""{_MASKS}, q as (select b.*, x, y, z from b join points using (scan_id, point_id)),
s as (select scan_id, grp, obs_id, count(*) as n, {", ".join(f"median({c}) as m{c}" for c in "xyz")}, sqrt({" + ".join(f"pow(quantile_cont({c}, 0.98) - quantile_cont({c}, 0.02), 2)" for c in "xyz")}) as scale from q group by all),
d as (select l.scan_id, l.grp, l.obs_id as a, r.obs_id as b, count(*) filter (l.point_id = r.point_id) as shared, min(sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2))) as gap from q l join q r on l.scan_id = r.scan_id and l.grp = r.grp and l.obs_id < r.obs_id group by all),
j as (select d.*, shared / greatest(least(u.n, v.n), 1) as overlap, sqrt(pow(u.mx - v.mx, 2) + pow(u.my - v.my, 2) + pow(u.mz - v.mz, 2)) as distance, abs(f.frame_order - g.frame_order) as frame_gap, f.frame_id = g.frame_id as same, greatest(3, ceil(0.15 * (select count(*) from o where o.scan_id = d.scan_id and o.grp = d.grp))) as continuity, u.scale + v.scale as sizes, greatest(0.08, least(0.3, 0.18 * (u.scale + v.scale))) as lim
 from d join s u on u.scan_id = d.scan_id and u.obs_id = d.a join s v on v.scan_id = d.scan_id and v.obs_id = d.b join o f on f.scan_id = d.scan_id and f.obs_id = d.a join o g on g.scan_id = d.scan_id and g.obs_id = d.b where shared > 0 or gap <= 0.3 or f.frame_id = g.frame_id),
t as (select *, same and overlap < 0.02 and gap > lim as conflict, shared >= 3 and overlap >= 0.03 as strong, not same and frame_gap <= continuity and gap <= lim and distance <= sizes + lim as near from j)
select scan_id, grp, a, b, shared, case when gap <= 0.3 then {q6("gap")} end as gap, {q6("distance")} as distance, conflict, not same and (strong or near) as accepted,
case when conflict then 'same_view_separate_masks' when same then 'same_view_masks_are_not_cross_view_evidence' when strong then 'shared_projected_3d_points' when near then 'spatially_adjacent_with_view_continuity' when frame_gap > continuity then 'no_overlap_and_view_gap_too_large' else 'insufficient_cross_view_relation' end as reason,
{q6("least(1, 0.55 * least(overlap / 0.25, 1) + 0.25 * greatest(0, 1 - gap / lim) + 0.2 * greatest(0, 1 - frame_gap / continuity))")} as score from t"""
)
def point_evidence(spark, sf_dir):
    """Pairs of a group's observations that share points or a view or come near each other, with gap, reason and score."""
    p, b = _masks(spark, sf_dir)
    o = b.select("scan_id", "grp", "obs_id").distinct().withColumns({"frame_id": F.floor(F.col("obs_id") / 4), "frame_order": F.floor(F.col("obs_id") / 4) * 2})
    found = pairs.evidence(o, b, p, ["scan_id", "grp"], ["scan_id"])
    return found.select("scan_id", "grp", "a", "b", "shared", r6("gap").alias("gap"), r6("distance").alias("distance"), "conflict", "accepted", "reason", r6("score").alias("score"))
