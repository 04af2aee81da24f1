"""Votes, tracks and label fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from habitrace.operators import votes
from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import FRAMES_SQL, frames, table

#: Label -> (canonical label, group).
GROUPS = [("view", "table", "table_group"), ("click", "desk", "table_group"), ("error", "bed", "bed_group"), ("signup", "sofa", "seat_group"), ("purchase", "chair", "seat_group")]
_GROUPS = "grp(kind, label, grp) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in GROUPS) + ")"


def _groups(spark):
    return F.broadcast(spark.createDataFrame(GROUPS, "kind string, label string, grp string"))


_T = f"{FRAMES_SQL}, t as (select scan_id, view_id, kind, sum(value) as weight, count(*) as support from frames group by all)"


def _tally(spark, sf_dir):
    return votes.tallies(frames(spark, sf_dir), ["scan_id", "view_id"], "kind", F.col("value"))


@query(f"with {_T}, k as (select *, row_number() over (partition by scan_id, view_id order by support desc, kind) as r from t) select scan_id, view_id, kind, support as best from k where r = 1")
def vote_majority(spark, sf_dir):
    return votes.majority(_tally(spark, sf_dir), ["scan_id", "view_id"], "kind", "support", False).select("scan_id", "view_id", "kind", "best")


@query(
    f"""with {_T}, k as (select *, row_number() over (partition by scan_id, view_id order by round(weight, 6) desc, kind desc) as r, sum(weight) over (partition by scan_id, view_id) as whole from t)
select scan_id, view_id, kind, {q6('weight / whole')} as consistency from k where r = 1 and support >= 2 and weight / whole >= 0.5"""
)
def vote_gated(spark, sf_dir):
    """Weighted majority behind gates of support and consistency; ties go to the greatest label."""
    t = _tally(spark, sf_dir)
    top = t.groupBy("scan_id", "view_id").agg(F.max(F.struct(F.round("weight", 6), "kind", "weight", "support")).alias("b"), F.sum("weight").alias("whole"))
    share = F.col("b.weight") / F.col("whole")
    return top.filter((F.col("b.support") >= 2) & (share >= 0.5)).select("scan_id", "view_id", F.col("b.kind").alias("kind"), r6(share).alias("consistency"))


@query(
    f"""with {FRAMES_SQL}, v as (select scan_id, count(distinct view_id) as visible from frames group by 1), s as (select scan_id, kind, count(distinct view_id) as seen from frames group by 1, 2)
select s.scan_id, s.kind, s.seen, v.visible, {q6('s.seen / v.visible')} as share from s join v using (scan_id)"""
)
def vote_visibility(spark, sf_dir):
    f = frames(spark, sf_dir)
    visible = f.groupBy("scan_id").agg(F.countDistinct("view_id").alias("visible"))
    seen = f.groupBy("scan_id", "kind").agg(F.countDistinct("view_id").alias("seen"))
    return seen.join(visible, "scan_id").select("scan_id", "kind", "seen", "visible", r6(F.col("seen") / F.col("visible")).alias("share"))


@query(
    f"""with {FRAMES_SQL}, {_GROUPS}, w as (select scan_id, g.grp, g.label, sum(sqrt(value)) as w from frames f join grp g using (kind) group by all),
r as (select *, sum(w) over (partition by scan_id, grp) as whole, count(*) over (partition by scan_id, grp) as n, row_number() over (partition by scan_id, grp order by round(w, 6) desc, label) as k from w)
select scan_id, grp, case when n > 1 and w / whole < 0.6 then grp else label end as label, {q6('w / whole')} as share from r where k = 1"""
)
def track_label_resolution(spark, sf_dir):
    """The heaviest label of a group; below 0.6 of the weight the generic group stands."""
    w = frames(spark, sf_dir).join(_groups(spark), "kind").groupBy("scan_id", "grp", "label").agg(F.sum(F.sqrt("value")).alias("w"))
    best = w.groupBy("scan_id", "grp").agg(F.min_by(F.struct("label", "w"), F.struct((-F.round("w", 6)).alias("m"), "label")).alias("b"), F.sum("w").alias("whole"), F.count("*").alias("n"))
    share = F.col("b.w") / F.col("whole")
    return best.select("scan_id", "grp", F.when((F.col("n") > 1) & (share < 0.6), F.col("grp")).otherwise(F.col("b.label")).alias("label"), r6(share).alias("share"))


@query(f"with {FRAMES_SQL}, {_GROUPS} select f.frame_id, g.label, g.grp from frames f left join grp g using (kind)")
def alias_normalise(spark, sf_dir):
    return frames(spark, sf_dir).join(_groups(spark), "kind", "left").select("frame_id", "label", "grp")


@query(f"with {FRAMES_SQL}, {_GROUPS} select g.grp, g.label, count(*) as n, count(distinct scan_id) as scans from frames f join grp g using (kind) group by 1, 2")
def label_group_counts(spark, sf_dir):
    return frames(spark, sf_dir).join(_groups(spark), "kind").groupBy("grp", "label").agg(F.count("*").alias("n"), F.countDistinct("scan_id").alias("scans"))


@query("select l_orderkey as scan_id, l_linenumber as object_id, l_returnflag || '_' || lpad(cast(row_number() over (partition by l_orderkey, l_returnflag order by l_extendedprice, l_linenumber) as varchar), 3, '0') as name from lineitem")
def instance_numbering(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"), "l_returnflag", "l_extendedprice")
    return votes.numbered(rows, ["scan_id"], "l_returnflag", [F.col("l_extendedprice"), F.col("object_id")]).select("scan_id", "object_id", "name")


@query(
    """select l_orderkey as scan_id, l_linenumber as object_id, case when count(*) over (partition by l_orderkey, l_returnflag) > 1
 then l_returnflag || ' ' || row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber) else l_returnflag end as name from lineitem"""
)
def display_names(spark, sf_dir):
    w = Window.partitionBy("l_orderkey", "l_returnflag")
    k = F.row_number().over(w.orderBy("l_linenumber"))
    name = F.when(F.count("*").over(w) > 1, F.concat_ws(" ", "l_returnflag", k.cast("string"))).otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"), name.alias("name"))


@query(f"with {FRAMES_SQL}, c as (select kind, view_id, count(distinct scan_id) as n from frames group by 1, 2) select kind, view_id from c where n >= 2 union all select kind, view_id from c where kind not in (select kind from c where n >= 2)")
def multiview_core(spark, sf_dir):
    """Ids seen from two scans or more; a label without any keeps all of its ids."""
    c = frames(spark, sf_dir).groupBy("kind", "view_id").agg(F.countDistinct("scan_id").alias("n"))
    any_core = F.max(F.col("n") >= 2).over(Window.partitionBy("kind"))
    return c.withColumn("any_core", any_core).filter(~F.col("any_core") | (F.col("n") >= 2)).select("kind", "view_id")


@query(
    f"""with {FRAMES_SQL}, s as (select distinct kind, scan_id from frames where value > 60), n as (select kind, count(*) as n from s group by 1),
i as (select a.kind as left_kind, b.kind as right_kind, count(*) as both from s a join s b using (scan_id) where a.kind < b.kind group by 1, 2)
select left_kind, right_kind, "both", {q6('"both" / (x.n + y.n - "both")')} as iou, {q6('"both" / least(x.n, y.n)')} as overlap from i join n x on x.kind = left_kind join n y on y.kind = right_kind""".replace("as both", 'as "both"')
)
def overlap_iou(spark, sf_dir):
    """Pairs of labels by the scans that they share, through the bridge of distinct (label, scan)."""
    s = frames(spark, sf_dir).filter("value > 60").select("kind", "scan_id").distinct()
    n = F.broadcast(s.groupBy("kind").agg(F.count("*").alias("n")))
    pairs = s.alias("a").join(s.alias("b"), "scan_id").filter("a.kind < b.kind").groupBy(F.col("a.kind").alias("left_kind"), F.col("b.kind").alias("right_kind")).agg(F.count("*").alias("both"))
    sized = pairs.join(n.select(F.col("kind").alias("left_kind"), F.col("n").alias("nx")), "left_kind").join(n.select(F.col("kind").alias("right_kind"), F.col("n").alias("ny")), "right_kind")
    return sized.select("left_kind", "right_kind", "both", r6(F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))).alias("iou"), r6(F.col("both") / F.least("nx", "ny")).alias("overlap"))


@query(
    f"""with {FRAMES_SQL}, {_GROUPS}, k as (select kind, scan_id, count(*) as hits from frames group by 1, 2), a as (select scan_id, sum(hits) as total from k group by 1)
select k.kind, k.scan_id, k.hits, {q6('k.hits / a.total')} as coverage from k join a using (scan_id) where k.hits >= 3 and k.hits / a.total >= 0.05"""
)
def candidate_overlap(spark, sf_dir):
    k = frames(spark, sf_dir).groupBy("kind", "scan_id").agg(F.count("*").alias("hits"))
    share = F.col("hits") / F.sum("hits").over(Window.partitionBy("scan_id"))
    return k.select("kind", "scan_id", "hits", share.alias("c")).filter("hits >= 3 and c >= 0.05").select("kind", "scan_id", "hits", r6("c").alias("coverage"))


@query(f"with {FRAMES_SQL}, {_GROUPS} select scan_id, {q6("coalesce(sum(value) filter (where grp = 'seat_group') / sum(value), 0.5)")} as consistency from frames join grp using (kind) group by 1")
def candidate_consistency(spark, sf_dir):
    compatible = F.sum(F.when(F.col("grp") == "seat_group", F.col("value")))
    return frames(spark, sf_dir).join(_groups(spark), "kind").groupBy("scan_id").agg(r6(F.coalesce(compatible / F.sum("value"), F.lit(0.5))).alias("consistency"))


@query(
    f"""with {FRAMES_SQL}, h as (select scan_id, kind, view_id, count(*) as hits from frames group by all having count(*) >= 2)
select scan_id, kind, count(*) as views, sum(hits)::bigint as hits from h group by 1, 2"""
)
def mask_membership(spark, sf_dir):
    h = frames(spark, sf_dir).groupBy("scan_id", "kind", "view_id").agg(F.count("*").alias("hits")).filter("hits >= 2")
    return h.groupBy("scan_id", "kind").agg(F.count("*").alias("views"), F.sum("hits").alias("hits"))


@query(
    f"""with {FRAMES_SQL}, m as (select kind, view_id, scan_id, quantile_cont(value, 0.5) as v, count(*) as n from frames group by all)
select kind, view_id, count(*) as frames, {q6('quantile_cont(v, 0.5)')} as position, sum(n)::bigint as hits from m group by 1, 2 having sum(n) >= 3"""
)
def multi_frame_localisation(spark, sf_dir):
    """Median of per-frame medians with at least three hits."""
    m = frames(spark, sf_dir).groupBy("kind", "view_id", "scan_id").agg(F.median("value").alias("v"), F.count("*").alias("n"))
    return m.groupBy("kind", "view_id").agg(F.count("*").alias("frames"), r6(F.median("v")).alias("position"), F.sum("n").alias("hits")).filter("hits >= 3")
