"""Streaming jobs drained over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.plans.define import q6, query, r6
from habitrace.session import new_path
from habitrace.sources.driver_tables import ROOM_POINTS_SQL, SCAN_SIZE, table
from habitrace.streaming import jobs
from habitrace.streaming import status as machine
from habitrace.streaming.keyed_table import KeyedTable


def _events(spark, sf_dir):
    return jobs.event_stream(spark, f"{sf_dir}/events.parquet")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by 1, 2")
def streaming_windows(spark, sf_dir):
    """Hours as they change (update mode); the latest state of each equals the batch windows."""
    rows = jobs.drain(spark, jobs.hourly(_events(spark, sf_dir)), "update", ["start", "event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("with h as (select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2) select start, event_type, n from h where start + interval '1 hour' <= (select max(ts) - interval '2 hours' from events)")
def streaming_closed_windows(spark, sf_dir):
    """Hours that the watermark has passed (append mode): the last ones are still open and are not given."""
    rows = jobs.drain(spark, jobs.hourly(_events(spark, sf_dir)), "append")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select user_id as scan_id, max(case event_type when 'signup' then 5 when 'view' then 15 when 'click' then 75 when 'error' then 88 else 100 end) as progress, max(ts) as at, count(*) as updates from events group by 1")
def streaming_status(spark, sf_dir):
    """State per scan, written as it changes; the latest row of each scan."""
    rows = jobs.drain(spark, jobs.status(_events(spark, sf_dir)), "update", ["user_id"])
    return rows.select(F.col("user_id").alias("scan_id"), "progress", F.col("at").cast("timestamp_ntz").alias("at"), "updates")


@query("select distinct user_id, event_type from events")
def streaming_dedup(spark, sf_dir):
    """One event of each user and type; which of a micro-batch's comes first is not defined, so the keys are given."""
    return jobs.drain(spark, jobs.deduplicated(_events(spark, sf_dir)), "append").select("user_id", "event_type")


@query(
    f"""with {ROOM_POINTS_SQL}, a as (select scan_id, floor(x / 0.15)::bigint as vx, floor(y / 0.15)::bigint as vy, floor(z / 0.15)::bigint as vz, label as frame_id, point_id % 3 as block_id, x, y, z from points where label >= 3),
f as (select scan_id, vx, vy, vz, count(*) as n, avg(x) as x, avg(y) as y, avg(z) as z from a group by 1, 2, 3, 4 having count(distinct frame_id) >= 3 and count(distinct block_id) >= 2),
b as (select scan_id, floor(x / 0.15)::bigint as vx, floor(y / 0.15)::bigint as vy, floor(z / 0.15)::bigint as vz, x, y, z from points where label < 3)
select scan_id, vx, vy, vz, 'base' as origin, count(*) as n, {q6('avg(x)')} as x, {q6('avg(y)')} as y, {q6('avg(z)')} as z from b group by 1, 2, 3, 4
union all select f.scan_id, f.vx, f.vy, f.vz, 'added', f.n, {q6('f.x')}, {q6('f.y')}, {q6('f.z')} from f where not exists (select 1 from b where b.scan_id = f.scan_id and b.vx = f.vx and b.vy = f.vy and b.vz = f.vz)"""
)
def incremental_fusion(spark, sf_dir):
    """Blocks of new points are summed by voxel as they come; what enough frames and blocks have seen is added to a base that never changes."""
    def role(rows):
        axis = lambda i: F.col("embedding")[i].cast("double")
        return rows.select(F.floor(F.col("vec_id") / SCAN_SIZE).alias("scan_id"), F.col("label").cast("bigint").alias("frame_id"), (F.col("vec_id") % 3).alias("block_id"), axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))

    added = role(jobs.file_stream(spark, f"{sf_dir}/embeddings.parquet").filter("label >= 3"))
    parts = jobs.drain(spark, added, "append", each=lambda batch: jobs.voxel_parts(batch, 0.15))
    base = jobs.fused(jobs.voxel_parts(role(table(spark, sf_dir, "embeddings").filter("label < 3")), 0.15), 1, 1)
    new = jobs.fused(parts).join(base.select("scan_id", "vx", "vy", "vz"), ["scan_id", "vx", "vy", "vz"], "left_anti")
    shown = lambda rows, origin: rows.select("scan_id", "vx", "vy", "vz", F.lit(origin).alias("origin"), "n", *(r6(c).alias(c) for c in "xyz"))
    return shown(base, "base").union(shown(new, "added"))


_DONE = "min(ts) filter (where event_type in ('purchase', 'error'))"


@query(
    f"""with s as (select user_id as scan_id, min(ts) as began, {_DONE} as ended from events group by 1)
select scan_id, ended is not null as done, (ceil(date_diff('microsecond', began, ended) / 3e6))::bigint as polls, began + to_seconds((ceil(date_diff('microsecond', began, ended) / 3e6))::bigint * 3) as seen from s"""
)
def status_polling(spark, sf_dir):
    """What a client sees that asks every three seconds: how often it asks until a scan is done or failed, and when it knows."""
    ended = F.min(F.when(F.col("event_type").isin("purchase", "error"), F.col("ts")))
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scan_id")).agg(F.min("ts").alias("began"), ended.alias("ended"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    polls = F.ceil((micros("ended") - micros("began")) / 3e6)
    seen = F.timestamp_micros(micros("began") + polls * 3000000).cast("timestamp_ntz")
    return s.select("scan_id", F.col("ended").isNotNull().alias("done"), polls.alias("polls"), seen.alias("seen"))


@query("select o_orderkey as task_id, case when o_orderpriority like '5%' then 'thread' else 'queue' end as runner, row_number() over (partition by o_custkey, o_orderpriority like '5%' order by o_orderdate, o_orderkey) as place from orders")
def task_dispatch(spark, sf_dir):
    """A project's tasks go to the queue in order of submission; where the broker doesn't take them they run in a thread."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    refused = F.col("o_orderpriority").startswith("5")
    place = F.row_number().over(Window.partitionBy("o_custkey", refused).orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_orderkey").alias("task_id"), F.when(refused, "thread").otherwise("queue").alias("runner"), place.cast("bigint").alias("place"))


_IDLE = 12 * 3_600_000_000
_STATUS_SQL = f"""with recursive m as (select user_id as scan_id, event_id, epoch_us(ts) as us, json_extract_string(props, '$.k')::bigint as k, event_type from events),
s as (select *, case event_type when 'signup' then 'extracting' when 'view' then 'reconstructing' when 'click' then case when k < 50 then 'cleaning' else 'understanding' end when 'error' then 'failed' else case when k < 80 then 'previewing' else 'done' end end as status from m),
w as (select (max(us) // 1000 - 7200000) * 1000 as mark from s),
e as (select scan_id, event_id, us, status, case status when 'extracting' then 0 when 'reconstructing' then 1 when 'cleaning' then 2 when 'understanding' then 3 when 'previewing' then 4 when 'done' then 5 else 9 end as rank,
  case status when 'extracting' then 5.0::double when 'reconstructing' then 15.0 + 58.0 * (k / 100.0::double) when 'cleaning' then 75.0 + 3.0 * (k / 100.0::double) when 'understanding' then 88.0 + 5.0 * (k / 100.0::double) when 'previewing' then 95.0 else 100.0 end as value,
  row_number() over (partition by scan_id order by us, event_id) as rn from s, w where us <= mark),
r as (
  select scan_id, rn, 1 as seq, 1 as attempt, status, rank, value, us as seen, us as "at", event_id, true as shown, null::bigint as silent, 1 as silent_attempt from e where rn = 1
  union all
  select scan_id, rn, seq1 + ok::int, attempt + (ok and status1 = 'failed')::int, case when ok then status2 else status1 end, case when ok then rank2 else rank1 end, case when ok then value2 else value1 end, us, us, event_id, ok, silent1, attempt
  from (select *, case when status1 = 'done' then false when status1 = 'failed' then status2 = 'extracting' when status2 = 'failed' or rank2 > rank1 then true else rank2 = rank1 and value2 - value1 >= 1.0 end as ok
    from (select e.scan_id, e.rn, e.us, e.event_id, e.status as status2, e.rank as rank2, e.value as value2, r.attempt, (q.quiet)::int + r.seq as seq1, case when q.quiet then 'failed' else r.status end as status1, case when q.quiet then 9 else r.rank end as rank1, case when q.quiet then 100.0 else r.value end as value1, case when q.quiet then r.seen + {_IDLE} end as silent1
      from r join e on e.scan_id = r.scan_id and e.rn = r.rn + 1, lateral (select r.status not in ('done', 'failed') and e.us - r.seen > {_IDLE} as quiet) q))),
z as (select scan_id, max_by(struct_pack(seq := seq, attempt := attempt, status := status, seen := seen), rn) as l from r group by 1),
o as (select scan_id, seq, attempt, status, round_even(value, 0)::int as progress, "at", event_id from r where shown
  union all select scan_id, seq - shown::int, silent_attempt, 'failed', 100, silent, null from r where silent is not null
  union all select scan_id, l.seq + 1, l.attempt, 'failed', 100, l.seen + {_IDLE}, null from z, w where l.status not in ('done', 'failed') and l.seen + {_IDLE} <= mark)
select scan_id, seq, attempt, status, progress, make_timestamp("at") as "at", event_id from o"""


@query(_STATUS_SQL)
def status_machine(spark, sf_dir):
    """Every change of a scan's status that is shown: stages forward, progress by whole steps, failure after twelve silent hours, retries as new runs."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "extracting").when(kind == "view", "reconstructing").when(kind == "click", F.when(k < 50, "cleaning").otherwise("understanding")).when(kind == "error", "failed").otherwise(F.when(k < 80, "previewing").otherwise("done"))
    events = _events(spark, sf_dir).select(F.col("user_id").alias("scan_id"), "event_id", "ts", stage.alias("status"), (k / 100).alias("fraction"))
    rows = jobs.drain(spark, machine.transitions(events, "2 hours", 12), "update", settings=machine.STORE)
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("select o_custkey as project_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) as report_id, max(o_orderdate) as created_at, max_by(o_totalprice, (o_orderdate, o_orderkey)) as score from orders group by 1")
def report_upsert(spark, sf_dir):
    """Reports merged into a keyed table in three batches, the second one twice: a retry changes nothing, the latest report of a project stays."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("score"))
    reports = KeyedTable(spark, new_path(spark, "reports"), ["project_id"], ["created_at", "report_id"], 8)
    for number in (0, 1, 1, 2):
        reports.merge(o.filter(F.col("report_id") % 3 == number), number)
    return reports.read()
