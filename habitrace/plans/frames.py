"""Frame timelines: keep-alive, buckets, gaps, islands, windows in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from habitrace.operators import exact
from habitrace.plans.define import d6, q6, query, r6
from habitrace.sources.driver_tables import FRAMES_SQL, frames, table

_F = f"with {FRAMES_SQL}"


def _timeline(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("scan_id").orderBy("ts", "frame_id")) - 1)


_TL = f"{_F}, tl as (select *, row_number() over (partition by scan_id order by ts, frame_id) - 1 as k from frames)"


@query(f"{_TL}, g as (select *, row_number() over (partition by scan_id, k // 4 order by value desc, frame_id) as r, max(k) over (partition by scan_id) as last from tl) select scan_id, frame_id from g where r = 1 or k = 0 or k = last")
def frame_keepalive(spark, sf_dir):
    """Each block of four frames keeps its sharpest; the first and last always stay."""
    last = F.max("k").over(Window.partitionBy("scan_id"))
    r = F.row_number().over(Window.partitionBy("scan_id", F.floor(F.col("k") / 4)).orderBy(F.desc("value"), "frame_id"))
    return _timeline(spark, sf_dir).select("scan_id", "frame_id", "k", r.alias("r"), last.alias("last")).filter("r = 1 or k = 0 or k = last").select("scan_id", "frame_id")


@query(f"{_TL}, n as (select *, count(*) over (partition by scan_id) as n from tl), b as (select *, floor(k * least(10, n) / n)::bigint as bucket from n) select scan_id, bucket, max_by(frame_id, {{'v': value, 'f': -frame_id}}) as frame_id from b group by 1, 2")
def bucket_best_frame(spark, sf_dir):
    n = F.count("*").over(Window.partitionBy("scan_id"))
    b = _timeline(spark, sf_dir).withColumn("n", n).withColumn("bucket", F.floor(F.col("k") * F.least(F.lit(10), "n") / F.col("n")))
    return b.groupBy("scan_id", "bucket").agg(F.max_by("frame_id", F.struct("value", (-F.col("frame_id")).alias("f"))).alias("frame_id"))


@query(
    f"""{_TL}, n as (select scan_id, count(*) as n, least(count(*), least(greatest(round(count(*) / 10.0), 48), 96))::bigint as m from frames group by 1),
w as (select scan_id, floor(i * (n - 1) / greatest(m - 1, 1) + 0.5)::bigint as k from n, lateral (select unnest(range(0, m)) as i)) select distinct tl.scan_id, tl.frame_id from tl join w on w.scan_id = tl.scan_id and w.k = tl.k"""
)
def keyframes(spark, sf_dir):
    """Evenly spaced keyframes, about a tenth, between 48 and 96 (all of a shorter scan); picked by arithmetic on the frame's place."""
    w = Window.partitionBy("scan_id")
    t = _timeline(spark, sf_dir).withColumn("n", F.count("*").over(w)).withColumn("m", F.least(F.col("n").cast("double"), F.least(F.greatest(F.round(F.col("n") / 10.0), F.lit(48.0)), F.lit(96.0))).cast("bigint"))
    places = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.floor(i * (F.col("n") - 1) / F.greatest(F.col("m") - 1, F.lit(1)) + 0.5))
    return t.filter(F.array_contains(places, F.col("k").cast("bigint"))).select("scan_id", "frame_id").distinct()


@query(f"{_TL}, d as (select *, row_number() over (partition by scan_id order by value, frame_id) as r, count(*) over (partition by scan_id) as n from tl) select scan_id, frame_id, r::bigint as place from d where r <= greatest(1, n // 20)")
def frame_drop(spark, sf_dir):
    """The worst twentieth of each scan's frames, worst first."""
    r = F.row_number().over(Window.partitionBy("scan_id").orderBy("value", "frame_id"))
    d = frames(spark, sf_dir).select("scan_id", "frame_id", r.cast("bigint").alias("place"), F.count("*").over(Window.partitionBy("scan_id")).alias("n"))
    return d.filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / 20))).select("scan_id", "frame_id", "place")


@query(f"{_TL}, p as (select scan_id, kind, lag(kind) over (partition by scan_id order by ts, frame_id) as prev from tl) select prev, kind, count(*) as n, count(distinct scan_id) as scans from p where prev is not null group by 1, 2")
def view_transitions(spark, sf_dir):
    prev = F.lag("kind").over(Window.partitionBy("scan_id").orderBy("ts", "frame_id"))
    return frames(spark, sf_dir).select("scan_id", "kind", prev.alias("prev")).filter("prev is not null").groupBy("prev", "kind").agg(F.count("*").alias("n"), F.countDistinct("scan_id").alias("scans"))


@query(f"{_F}, d as (select scan_id, sqrt(pow(value - lag(value) over w, 2) + pow(view_id - lag(view_id) over w, 2)) as d from frames window w as (partition by scan_id order by ts, frame_id)) select scan_id, {q6('sum(d)')} as length from d group by 1")
def path_length(spark, sf_dir):
    w = Window.partitionBy("scan_id").orderBy("ts", "frame_id")
    step = F.hypot(F.col("value") - F.lag("value").over(w), (F.col("view_id") - F.lag("view_id").over(w)).cast("double"))
    return frames(spark, sf_dir).select("scan_id", step.alias("d")).groupBy("scan_id").agg(r6(F.sum("d")).alias("length"))


@query(f"{_F}, g as (select scan_id, value - lag(value) over (partition by scan_id order by value) as gap from frames) select scan_id, {q6('max(gap)')} as gap from g group by 1")
def max_gap(spark, sf_dir):
    gap = F.col("value") - F.lag("value").over(Window.partitionBy("scan_id").orderBy("value"))
    return frames(spark, sf_dir).select("scan_id", gap.alias("gap")).groupBy("scan_id").agg(r6(F.max("gap")).alias("gap"))


@query(
    f"""{_F}, b as (select distinct scan_id, floor(value / 2)::bigint as bin from frames), i as (select *, bin - row_number() over (partition by scan_id order by bin) as island from b),
r as (select scan_id, island, min(bin) as first_bin, count(*) as length from i group by 1, 2), k as (select *, row_number() over (partition by scan_id order by length desc, first_bin) as k from r) select scan_id, first_bin, length from k where k = 1"""
)
def islands_runs(spark, sf_dir):
    """The longest run of occupied bins per scan."""
    b = frames(spark, sf_dir).select("scan_id", F.floor(F.col("value") / 2).alias("bin")).distinct()
    island = F.col("bin") - F.row_number().over(Window.partitionBy("scan_id").orderBy("bin"))
    runs = b.withColumn("island", island).groupBy("scan_id", "island").agg(F.min("bin").alias("first_bin"), F.count("*").alias("length"))
    return runs.groupBy("scan_id").agg(F.min_by(F.struct("first_bin", "length"), F.struct((-F.col("length")).alias("l"), "first_bin")).alias("b")).select("scan_id", "b.first_bin", "b.length")


@query(
    f"""{_F}, c as (select scan_id, kind, value, sum(view_id + 1) over (partition by scan_id, kind order by value, frame_id rows unbounded preceding) as cum, sum(view_id + 1) over (partition by scan_id, kind) as total from frames)
select scan_id, kind, {q6('min(value)')} as median from c where cum >= total / 2.0 group by 1, 2"""
)
def weighted_median(spark, sf_dir):
    w = Window.partitionBy("scan_id", "kind")
    weight = F.col("view_id") + 1
    c = frames(spark, sf_dir).select("scan_id", "kind", "value", F.sum(weight).over(w.orderBy("value", "frame_id").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum(weight).over(w).alias("total"))
    return c.filter(F.col("cum") >= F.col("total") / 2.0).groupBy("scan_id", "kind").agg(r6(F.min("value")).alias("median"))


@query(f"{_F}, q as (select scan_id, kind, quantile_cont(value, 0.25) as lo, quantile_cont(value, 0.5) as mid, quantile_cont(value, 0.75) as hi from frames group by 1, 2) select scan_id, kind, {q6('(hi - lo) / nullif(mid, 0)')} as spread, coalesce((hi - lo) / nullif(mid, 0) <= 1.2, false) as agrees from q")
def iqr_gate(spark, sf_dir):
    q = exact.quantiles(frames(spark, sf_dir).select("scan_id", "kind", "value"), ["scan_id", "kind"], "value", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    spread = F.try_divide(F.col("hi") - F.col("lo"), F.col("mid"))
    return q.select("scan_id", "kind", d6(spread).alias("spread"), F.coalesce(spread <= 1.2, F.lit(False)).alias("agrees"))


@query(f"{_F}, g as (select scan_id, kind, value - lag(value) over (partition by scan_id, kind order by value) as gap, max(value) over (partition by scan_id, kind) - min(value) over (partition by scan_id, kind) as span from frames) select scan_id, kind, 1 + count(*) filter (where gap > 0.12 * span) as clusters from g group by 1, 2")
def depth_gap_clusters(spark, sf_dir):
    w = Window.partitionBy("scan_id", "kind")
    gap = F.col("value") - F.lag("value").over(w.orderBy("value"))
    g = frames(spark, sf_dir).select("scan_id", "kind", gap.alias("gap"), (F.max("value").over(w) - F.min("value").over(w)).alias("span"))
    return g.groupBy("scan_id", "kind").agg((1 + F.count_if(F.col("gap") > 0.12 * F.col("span"))).alias("clusters"))


@query(f"{_F}, b as (select scan_id, least(floor(value / 2)::bigint, 47) as bin, count(*) as n from frames group by 1, 2), p as (select *, max(n) over (partition by scan_id) as peak from b) select scan_id, (max(bin) - min(bin)) * 2.0 as width from p where n >= 0.5 * peak group by 1")
def jamb_width(spark, sf_dir):
    """Distance between the outermost peaks of a 48-bin histogram."""
    b = frames(spark, sf_dir).groupBy("scan_id", F.least(F.floor(F.col("value") / 2), F.lit(47)).alias("bin")).agg(F.count("*").alias("n"))
    p = b.withColumn("peak", F.max("n").over(Window.partitionBy("scan_id"))).filter("n >= 0.5 * peak")
    return p.groupBy("scan_id").agg(((F.max("bin") - F.min("bin")) * F.lit(2.0)).alias("width"))


@query(f"{_F}, k as (select *, row_number() over (partition by scan_id order by value, frame_id) as r, count(*) over (partition by scan_id) as n from frames) select scan_id, count(*) as n, {q6('avg(value)')} as low from k where r <= greatest(10, n // 10) group by 1")
def lowest_decile(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("scan_id").orderBy("value", "frame_id"))
    k = frames(spark, sf_dir).select("scan_id", "value", r.alias("r"), F.count("*").over(Window.partitionBy("scan_id")).alias("n"))
    return k.filter(F.col("r") <= F.greatest(F.lit(10), F.floor(F.col("n") / 10))).groupBy("scan_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("low"))


@query(f"{_F}, f as (select scan_id, view_id, kind, row_number() over (partition by scan_id, view_id, kind order by ts, frame_id) as r, ts, frame_id from frames), c as (select scan_id, frame_id, sum(case when r = 1 then 1 else 0 end) over (partition by scan_id order by ts, frame_id rows unbounded preceding)::bigint as seen from f) select scan_id, frame_id, seen from c")
def cumulative_growth(spark, sf_dir):
    """How many different (view, label) pairs have been seen up to each frame."""
    first = F.row_number().over(Window.partitionBy("scan_id", "view_id", "kind").orderBy("ts", "frame_id")) == 1
    f = frames(spark, sf_dir).withColumn("new", first.cast("bigint"))
    return f.select("scan_id", "frame_id", F.sum("new").over(Window.partitionBy("scan_id").orderBy("ts", "frame_id").rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type as kind, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by 1, 2")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "kind", "n", "total")


@query("select time_bucket(interval '30 minutes', ts) - i * interval '30 minutes' as start, count(*) as n, count(distinct user_id) as scans from events, (values (0), (1)) t(i) group by 1")
def sliding_windows(spark, sf_dir):
    """One-hour windows every half hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("scans")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "scans")


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '4 hours' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id as scan_id, min(ts) as start, max(ts) + interval '4 hours' as "end", count(*) as n from s group by user_id, k"""
)
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy(F.col("user_id").alias("scan_id"), F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("scan_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")
