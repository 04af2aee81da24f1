"""Records around a scan: references, selections, cameras, documents, sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from habitrace.functions import text
from habitrace.operators import exact, records
from habitrace.plans.define import d6, q6, query, r6
from habitrace.sources.driver_tables import FRAMES_SQL, ROOM_BOXES_SQL, ROOM_POINTS_SQL, frames, room_boxes, room_points, table

_B, _F, _P = f"with {ROOM_BOXES_SQL}", f"with {FRAMES_SQL}", f"with {ROOM_POINTS_SQL}"


@query("select user_id as scan_id, array_to_string(list_sort(list_distinct(list(event_type))), '. ') || '.' as prompt from events group by 1")
def prompt_join(spark, sf_dir):
    """The phrases of a scan as one prompt; spaces and closing dots of a phrase go, empty ones too."""
    said = F.array_sort(F.collect_set(F.concat(F.lit(" "), "event_type", F.lit(".."))))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scan_id")).agg(text.prompt(F.array_append(said, F.lit(" . "))).alias("prompt"))


_STAGES, _DETAILS = ("reconstructing", "extracting", "cleaning", "understanding", "scoring"), ("CUDA error", "Weight file is gone", "ffmpeg exited", "no idea")
_PICK = "['" + "', '".join(_STAGES) + "'][o_orderkey % 5 + 1] as stage, ['" + "', '".join(d.lower() for d in _DETAILS) + "'][o_custkey % 4 + 1] as detail"


@query(
    f"""with f as (select o_orderkey as scan_id, {_PICK} from orders) select scan_id, case when stage in ('reconstructing', 'extracting') then case when detail like '%cuda%' or detail like '%out of memory%' then 'gpu_memory' when detail like '%weight%' then 'weights_missing' when detail like '%ffmpeg%' then 'frame_extraction' else 'reconstruction' end
 when stage in ('cleaning', 'understanding') then stage else 'pipeline' end as code from f"""
)
def failure_messages(spark, sf_dir):
    pick = lambda values, c: F.array(*map(F.lit, values))[F.pmod(c, F.lit(len(values))).cast("int")]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), records.failure_code(pick(_STAGES, F.col("o_orderkey")), pick(_DETAILS, F.col("o_custkey"))).alias("code"))


@query("select c_custkey as user_id, trim(c_name) as name, lower(c_name || '@Example.ORG') as email, length(trim(c_name)) between 1 and 18 as name_ok, c_custkey % 9 <> 0 as org_ok from customer")
def account_inputs(spark, sf_dir):
    """Required texts are stripped and must not be blank, e-mail addresses are lower-cased, lengths are bounded."""
    name = F.concat(F.lit("  "), "c_name", F.lit(" \t"))
    org = F.when(F.col("c_custkey") % 9 == 0, F.lit(" \n ")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), text.stripped(name).alias("name"), F.lower(F.concat("c_name", F.lit("@Example.ORG"))).alias("email"), text.bounded(name, 1, 18).alias("name_ok"), text.bounded(org, 1, 120).alias("org_ok"))


@query("with w as (select user_id as scan_id, event_type as label, sum(value) as weight from events group by 1, 2) select scan_id, label, round(weight, 6) + 0.0 as weight, (rank() over (partition by scan_id order by weight desc, label))::bigint as place, round(weight / sum(weight) over (partition by scan_id), 6) + 0.0 as share from w")
def label_shares(spark, sf_dir):
    """Weights by label accumulated, ranked, and as shares of the whole; a share of nothing is not a number."""
    w = Window.partitionBy("scan_id")
    events = exact.added(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")
    per = events.groupBy(F.col("user_id").alias("scan_id"), F.col("event_type").alias("label")).agg(exact.in_order().alias("w"))
    place = F.rank().over(w.orderBy(F.col("w").desc_nulls_last(), F.col("label").asc_nulls_last()))
    share = F.coalesce(F.try_divide("w", F.sum("w").over(w)), F.col("w") * F.lit(float("inf")))
    return per.select("scan_id", "label", d6("w").alias("weight"), place.cast("bigint").alias("place"), d6(share).alias("share"))


@query("select l_orderkey as scan_id, min_by(l_linenumber, {'n': l_linenumber, 'p': l_partkey, 'q': l_quantity}) filter (where l_returnflag <> 'A' and l_discount > 0) as risk_id, min(case when l_returnflag <> 'A' and l_discount > 0 then l_linenumber end) is not null as found from lineitem group by 1")
def client_filters(spark, sf_dir):
    """What a client shows first: hidden codes are left out, then the first strictly positive clearance."""
    shown = ~F.col("l_returnflag").isin("A") & (F.col("l_discount") > 0)
    first = F.min(F.when(shown, F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id")).agg(first.alias("risk_id"), first.isNotNull().alias("found"))


@query("select l_orderkey as scan_id, arg_min(l_linenumber, {'k': l_returnflag <> 'R', 'n': l_linenumber}) as opening_id, bool_or(l_returnflag = 'R') as door from lineitem group by 1")
def first_door(spark, sf_dir):
    """The first door in the order of a client's list, else the first opening."""
    rank = F.struct((F.col("l_returnflag") != "R").alias("k"), F.col("l_linenumber").alias("n"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id")).agg(F.min_by("l_linenumber", rank).alias("opening_id"), F.bool_or(F.col("l_returnflag") == "R").alias("door"))


@query("select l_orderkey as scan_id, l_linenumber as item_id, l_partkey as part_id, l_returnflag = 'R' as opening from lineitem left join part on p_partkey = l_partkey where l_linestatus = 'O' and p_partkey is not null and (l_returnflag = 'R' or p_size > 10)")
def verified_inputs(spark, sf_dir):
    """Objects need a centre and sizes, openings a centre; both must be verified."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = l.join(p, l.l_partkey == p.p_partkey, "left")
    status, opening = F.when(F.col("l_linestatus") == "O", "verified").otherwise("rejected"), F.col("l_returnflag") == "R"
    size = F.when(F.col("p_size") > 10, F.col("p_size"))
    kept = j.filter(F.when(opening, records.verified(status, F.col("p_partkey"))).otherwise(records.verified(status, F.col("p_partkey"), size)))
    return kept.select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("item_id"), F.col("l_partkey").alias("part_id"), opening.alias("opening"))


_REFS = "r as (select l_orderkey as scan_id, l_linenumber as reference_id, case when l_returnflag = 'R' then 'door' when l_returnflag = 'A' then 'bed' else 'table' end as kind, p_size / 50.0 as metres, case when l_discount > 0.02 then l_quantity / 20 end as measured from lineitem join part on p_partkey = l_partkey)"


def _references(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    kind = F.when(F.col("l_returnflag") == "R", "door").when(F.col("l_returnflag") == "A", "bed").otherwise("table")
    measured = F.when(F.col("l_discount") > 0.02, F.col("l_quantity") / 20)
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("reference_id"), kind.alias("kind"), (F.col("p_size") / 50.0).alias("metres"), measured.alias("measured"))


@query(f"with {_REFS}, k as (select scan_id, min({{'k': kind <> 'door', 'n': reference_id, 's': metres / measured}}) as b from r where measured > 0 group by 1) select scan_id, b.n as reference_id, round(b.s, 6) + 0.0 as scale from k")
def forced_reference(spark, sf_dir):
    """Doors first, the first measurable wins; of rows that share a number the least scale."""
    found = records.forced_scale(_references(spark, sf_dir), "scan_id")
    return found.select("scan_id", "reference_id", r6("scale").alias("scale"))


@query(
    f"""with {_REFS}, s as (select scan_id, kind, metres / measured as s from r where measured > 0), u as (select scan_id, count(*) as n, quantile_cont(s, 0.5) as med, max(s) as hi, min(s) as lo, quantile_cont(s, 0.5) filter (where kind = 'bed') as bed from s group by 1)
select scan_id, n, {q6("case when bed is null and n > 1 and (hi - lo) / med > 0.15 then null else coalesce(bed, med) end")} as scale, case when bed is not null then 'bed' when n > 1 and (hi - lo) / med > 0.15 then 'failed' when n = 1 then 'low' else 'ok' end as status from u"""
)
def anchored_scale(spark, sf_dir):
    """The median scale, a bed's length instead where there is one, failure on disagreement beyond 15 %."""
    rows = _references(spark, sf_dir).filter("measured > 0").select("scan_id", "kind", (F.col("metres") / F.col("measured")).alias("scale"))
    return records.reference_scale(rows, "scan_id").withColumn("scale", r6("scale"))


@query("select p_partkey as object_id, round(case when p_size > 3 and p_retailprice > 905 then 500 * 2.0 / p_size / (p_retailprice / 300) end, 6) + 0.0 as by_pixels, round(case when p_size > 5 then 2.0 / (p_size - 5) end, 6) + 0.0 as by_door from part")
def prior_scales(spark, sf_dir):
    """Scale from a known length in the image, and from the standard height of doors; NULL where a measure is not positive."""
    pixels, distance = F.when(F.col("p_size") > 3, F.col("p_size")).otherwise(F.lit(0)), F.when(F.col("p_retailprice") > 905, F.col("p_retailprice") / 300).otherwise(F.lit(-1.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), r6(records.scale_from_pixels(pixels, F.lit(2.0), distance, F.lit(500.0))).alias("by_pixels"), r6(records.scale_from_door(F.col("p_size") - 5.0)).alias("by_door"))


@query(
    f"""{_B} select box_id, {q6('cos(yaw)')} as r00, {q6('-sin(yaw)')} as r01, {q6('-(cos(yaw) * cx - sin(yaw) * cy)')} as t0, {q6('-(sin(yaw) * cx + cos(yaw) * cy)')} as t1, {q6('-cz')} as t2, 640 as width from boxes"""
)
def camera_records(spark, sf_dir):
    """Cameras from their JSON: K, R and t = -R p."""
    c, s = F.cos("yaw"), F.sin("yaw")
    rotation = F.array(F.array(c, -s, F.lit(0.0)), F.array(s, c, F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    written = F.to_json(F.struct(F.col("box_id").alias("id"), *(F.lit(v).alias(k) for k, v in (("fx", 500.0), ("fy", 500.0), ("cx", 320.0), ("cy", 240.0), ("width", 640), ("height", 480))), rotation.alias("rotation"), F.array("cx", "cy", "cz").alias("position")))
    b = room_boxes(spark, sf_dir).select(records.camera(written).alias("c"))
    return b.select(F.col("c.id").alias("box_id"), r6(F.col("c.r")[0][0]).alias("r00"), r6(F.col("c.r")[0][1]).alias("r01"), *(r6(F.col("c.t")[i]).alias(f"t{i}") for i in range(3)), F.col("c.image_size")[0].alias("width"))


@query(f"{_B} select box_id, {q6('500 * cx / greatest(cz, 1e-6) + 320')} as u, {q6('500 * cy / greatest(cz, 1e-6) + 240')} as v, {q6('cos(yaw)')} as ax, {q6('sin(yaw)')} as ay from boxes where cz > 0.01 or cz < 0 and abs(cx) < 0.5 and abs(cy) < 0.5")
def refinement_projection(spark, sf_dir):
    """Box centres through a pinhole that never divides by less than 1e-6, with the direction of the long axis."""
    u, v = records.project(F.col("cx"), F.col("cy"), F.col("cz"), 500.0, 500.0, 320.0, 240.0)
    b = room_boxes(spark, sf_dir).filter("cz > 0.01 or cz < 0 and abs(cx) < 0.5 and abs(cy) < 0.5")
    return b.select("box_id", r6(u).alias("u"), r6(v).alias("v"), r6(F.cos("yaw")).alias("ax"), r6(F.sin("yaw")).alias("ay"))


@query(f"{_F} select frame_id, to_json({{'observation_id': frame_id, 'frame_id': view_id, 'semantic_label': kind, 'canonical_group': upper(kind), 'assigned_instances': [kind || '_001']}}) as document from frames")
def observation_documents(spark, sf_dir):
    """Observations as JSON, keys in a fixed order."""
    doc = F.to_json(F.struct(F.col("frame_id").alias("observation_id"), F.col("view_id").alias("frame_id"), F.col("kind").alias("semantic_label"), F.upper("kind").alias("canonical_group"), F.array(F.concat("kind", F.lit("_001"))).alias("assigned_instances")))
    return frames(spark, sf_dir).select("frame_id", doc.alias("document"))


@query("select event_id, round_even(value, 0)::int as progress, round_even(value, 0) between 0 and 100 as ok from events")
def request_schema(spark, sf_dir):
    """Progress of a request is rounded half to even and must lie in 0 to 100."""
    p = F.bround("value", 0)
    return table(spark, sf_dir, "events").select("event_id", p.cast("int").alias("progress"), p.between(0, 100).alias("ok"))


@query("select kind, o_orderkey as origin, case kind when 'project' then o_custkey else o_orderkey + 2000000000 end as record_id, 'imported' as status from orders, (values ('project'), ('scan'), ('report')) k(kind) where o_orderpriority like '1%'")
def import_accepted(spark, sf_dir):
    """Accepted artefacts become a project, a scan and a report each."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1"))
    kind = F.explode(F.array(F.lit("project"), F.lit("scan"), F.lit("report"))).alias("kind")
    return o.select(kind, F.col("o_orderkey").alias("origin"), "o_custkey").select("kind", "origin", F.when(F.col("kind") == "project", F.col("o_custkey")).otherwise(F.col("origin") + 2000000000).alias("record_id"), F.lit("imported").alias("status"))


@query(
    f"""{_F}, t as (select scan_id, (row_number() over (partition by scan_id order by ts, frame_id) - 1) as frame_no from frames), c as (select scan_id, count(*) // 2 as anchor from t group by 1),
u as (select c.scan_id as scan_id, case when i < 0 then 0 else 2 end as part, 'anchor' as source, anchor + i as frame_no from c cross join (select unnest(range(-3, 3)) as i) k join t on t.scan_id = c.scan_id and t.frame_no = anchor + i union all select scan_id, 1, 'clip', j from c, (select unnest(range(0, 4)) as j))
select scan_id, source, frame_no::bigint as frame_no, row_number() over (partition by scan_id order by part, frame_no) - 1 as place from u"""
)
def supplement_sequence(spark, sf_dir):
    """A clip of four frames between the three frames before and after the middle of each scan."""
    k = F.row_number().over(Window.partitionBy("scan_id").orderBy("ts", "frame_id")) - 1
    t = frames(spark, sf_dir).select("scan_id", k.cast("bigint").alias("frame_no"))
    clips = t.groupBy("scan_id").agg(F.floor(F.count("*") / 2).alias("anchor")).select("scan_id", F.lit(1).alias("clip_id"), "anchor", F.lit(4).alias("length"))
    return records.with_supplements(t, clips, ["scan_id"]).select("scan_id", "source", "frame_no", "place")


_BAD = "value < greatest(12, 0.18 * med) or dark > 0.72 or clipped > 0.72"


@query(
    f"""{_F}, m as (select scan_id, quantile_cont(value, 0.5) as med from frames group by 1), q as (select f.scan_id, frame_id, value, med, (frame_id % 100) / 100.0 as dark, (view_id % 90) / 100.0 as clipped from frames f join m using (scan_id))
select scan_id, frame_id, {_BAD} as severe, {q6('value - 1000 * greatest(dark, clipped)')} as rescue from q"""
)
def frame_quality(spark, sf_dir):
    """Frames too blurred (against 12 and 18 % of the median), too dark or clipped; and the rank by which a second is rescued."""
    f = frames(spark, sf_dir).withColumns({"dark": (F.col("frame_id") % 100) / 100.0, "clipped": (F.col("view_id") % 90) / 100.0})
    q = f.join(f.groupBy("scan_id").agg(F.median("value").alias("med")), "scan_id")
    bad = (F.col("value") < F.greatest(F.lit(12.0), 0.18 * F.col("med"))) | (F.col("dark") > 0.72) | (F.col("clipped") > 0.72)
    return q.select("scan_id", "frame_id", bad.alias("severe"), r6(F.col("value") - 1000 * F.greatest("dark", "clipped")).alias("rescue"))


@query(
    """with c as (select l_orderkey as scan_id, count(*) filter (where l_linestatus = 'O' and l_returnflag <> 'R') as objects, count(*) filter (where l_linestatus = 'O' and l_returnflag = 'R') as openings, count(*) filter (where l_returnflag = 'A') as unusable from lineitem group by 1)
select o_orderkey as scan_id, '1.0' as schema_version, coalesce(objects, 0) as objects, coalesce(openings, 0) as openings, case when coalesce(objects, 0) = 0 or coalesce(openings, 0) = 0 then 'not_evaluable' when unusable > 2 then 'blocked' else 'ok' end as route_status, sha256(o_orderkey || ':' || coalesce(objects, 0)) as input_hash from orders left join c on c.scan_id = o_orderkey"""
)
def foundation_documents(spark, sf_dir):
    """One foundation record a scan: verified items, the state of its main route, the hash of its inputs."""
    l = table(spark, sf_dir, "lineitem")
    ok, door = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    c = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(ok & ~door).alias("objects"), F.count_if(ok & door).alias("openings"), F.count_if(F.col("l_returnflag") == "A").alias("unusable"))
    j = table(spark, sf_dir, "orders").select("o_orderkey").join(c, "o_orderkey", "left").fillna(0, ["objects", "openings"])
    state = F.when((F.col("objects") == 0) | (F.col("openings") == 0), "not_evaluable").when(F.col("unusable") > 2, "blocked").otherwise("ok")
    key = F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("objects").cast("string")), 256)
    return j.select(F.col("o_orderkey").alias("scan_id"), F.lit("1.0").alias("schema_version"), "objects", "openings", state.alias("route_status"), key.alias("input_hash"))


@query("select o_orderkey as scan_id, case when o_orderpriority like '3%' then 'partial' else 'complete' end as status, case when o_orderpriority like '3%' then 'summary,scores' else 'summary,scores,figures' end as sections from orders")
def composed_reports(spark, sf_dir):
    """A report whose figures could not be rendered is partial: it keeps its other sections."""
    failed = F.col("o_orderpriority").startswith("3")
    sections = F.concat_ws(",", F.lit("summary"), F.lit("scores"), F.when(~failed, F.lit("figures")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.when(failed, "partial").otherwise("complete").alias("status"), sections.alias("sections"))


@query(
    """with n as (select o_orderkey as scan_id, sha256(o_orderstatus || (o_custkey % 3)) as now, o_orderpriority like '4%' as failed from orders), b as (select l_orderkey as scan_id, sha256(case when l_returnflag = 'R' then 'F' else 'O' end || (l_suppkey % 3)) as before from lineitem where l_linenumber = 1)
select n.scan_id, case when b.before is null then case when failed then 'none' else 'create' end when failed then 'remove' when b.before = n.now then 'keep' else 'replace' end as action from n left join (select scan_id, max(before) as before from b group by 1) b using (scan_id)"""
)
def stage_refresh(spark, sf_dir):
    """Outputs are kept while the hash of their inputs stands, replaced when it changes, and removed when a retry fails."""
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.sha2(F.concat("o_orderstatus", (F.col("o_custkey") % 3).cast("string")), 256).alias("now"), F.col("o_orderpriority").startswith("4").alias("failed"))
    old = F.sha2(F.concat(F.when(F.col("l_returnflag") == "R", "F").otherwise("O"), (F.col("l_suppkey") % 3).cast("string")), 256)
    b = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("scan_id")).agg(F.max(old).alias("before"))
    action = F.when(F.col("before").isNull(), F.when(F.col("failed"), "none").otherwise("create")).when(F.col("failed"), "remove").when(F.col("before") == F.col("now"), "keep").otherwise("replace")
    return n.join(b, "scan_id", "left").select("scan_id", action.alias("action"))


_CL = lambda c: f"least(greatest({c}, 0.0), 1.0)"
_PUR = "e as (select frame_id, value / 60 as detector, (view_id % 100) / 100.0 as cross_view, (frame_id % 97) / 96.0 as purity, (frame_id % 53) / 40.0 as gap, (frame_id % 31) / 60.0 as conflict, (frame_id % 89) / 88.0 as retained, (frame_id % 41) / 60.0 as rejected, frame_id % 17 as kept from frames)"


@query(
    f"""{_F}, {_PUR}, q as (select *, 0.20 * {_CL('detector')} + 0.25 * {_CL('cross_view')} + 0.20 * {_CL('purity')} + 0.15 * (1 - {_CL('gap')}) + 0.10 * (1 - {_CL('conflict')}) + 0.10 * least({_CL('retained')} / 0.7, 1.0) as quality from e)
select frame_id, {q6('quality')} as quality, case when kept <= 0 then 'rejected' when conflict >= 0.35 then 'ambiguous' when quality >= 0.78 and rejected < 0.10 then 'high_quality' when quality >= 0.60 and rejected < 0.45 then 'usable' when quality >= 0.40 then 'ambiguous' else 'contaminated' end as status,
 case when conflict >= 0.30 and purity < 0.10 and gap >= 0.45 then 'candidate_conflict' when conflict >= 0.35 and cross_view < 0.35 then 'semantic_conflict' when cross_view < 0.05 and kept <> 1 and purity < 0.20 then 'unsupported' when gap >= 0.45 and cross_view < 0.35 and purity < 0.20 then 'depth_gap' when retained < 0.005 and cross_view < 0.20 then 'fragment' end as reason from q"""
)
def observation_purification(spark, sf_dir):
    """Quality, status and first reject reason of observations (the purity stands for the compatible share too)."""
    c, n = F.col, (lambda name, m, d: (F.col(name) % m) / float(d))
    e = frames(spark, sf_dir).select("frame_id", (c("value") / 60).alias("detector"), n("view_id", 100, 100).alias("cross_view"), n("frame_id", 97, 96).alias("purity"), n("frame_id", 53, 40).alias("gap"), n("frame_id", 31, 60).alias("conflict"), n("frame_id", 89, 88).alias("retained"), n("frame_id", 41, 60).alias("rejected"), (c("frame_id") % 17).alias("kept"))
    quality = records.purification("detector", "cross_view", "purity", "gap", "conflict", "retained")
    status = records.purification_status(quality, c("conflict"), c("rejected"), c("kept"))
    return e.select("frame_id", r6(quality).alias("quality"), status.alias("status"), records.component_reject(c("conflict"), c("purity"), c("gap"), c("cross_view"), c("retained"), c("kept") == 1).alias("reason"))


@query(
    f"""{_F}, e as (select scan_id, kind, count(distinct view_id) as views, ln(max(greatest(value, 1))) - ln(min(greatest(value, 1))) as areas, count(*) as n, avg(value) / max(value) as boundary, max(value) / sum(value) as agreement, count(*) filter (where value > 30) / count(*) as cross_view from frames group by 1, 2)
select scan_id, kind, {q6("0.13 * least(views / 4, 1) + 0.15 * 0.75 * least(views / 4, 1) + 0.04 * least(areas / 1.5, 1) + 0.22 * boundary + 0.13 * agreement + 0.12 * cross_view + 0.08 * least(n / 300, 1) + 0.05 / greatest(views % 3, 1) + 0.08 * (views % 5) / 4")} as completeness from e"""
)
def completeness_score(spark, sf_dir):
    """The nine factors of completeness: views, their diversity, areas, boundary, labels, cross-view, points, fragments, candidates."""
    one, v = F.lit(1.0), F.greatest("value", F.lit(1.0))
    e = frames(spark, sf_dir).groupBy("scan_id", "kind").agg(F.countDistinct("view_id").alias("views"), (F.ln(F.max(v)) - F.ln(F.min(v))).alias("areas"), F.count("*").alias("n"), (F.avg("value") / F.max("value")).alias("boundary"), (F.max("value") / F.sum("value")).alias("agreement"), (F.count_if(F.col("value") > 30) / F.count("*")).alias("cross_view"))
    support = F.least(F.col("views") / 4, one)
    factors = {
        "support_views": support, "view_diversity": 0.75 * support, "area_diversity": F.least(F.col("areas") / 1.5, one), "boundary_stability": F.col("boundary"), "semantic_consistency": F.col("agreement"), "cross_view": F.col("cross_view"),
        "point_support": F.least(F.col("n") / 300, one), "fragment_consistency": 1 / F.greatest(F.col("views") % 3, F.lit(1)), "candidate_consistency": (F.col("views") % 5) / 4,
    }
    return e.select("scan_id", "kind", r6(records.completeness(factors)).alias("completeness"))


@query(f"{_P} select scan_id, label, count(distinct point_id) as n, min(point_id) as first, max(point_id) as last, sum(point_id)::bigint as total from points group by 1, 2")
def instance_sets(spark, sf_dir):
    """Point ids keyed by instance, kept as a bridge table in the shared folder and read back."""
    from habitrace.session import new_path

    path = new_path(spark, "instances")
    room_points(spark, sf_dir).select("scan_id", F.col("label").alias("instance"), "point_id").write.partitionBy("instance").parquet(path)
    kept = spark.read.parquet(path).groupBy("scan_id", F.col("instance").cast("bigint").alias("label"))
    return kept.agg(F.countDistinct("point_id").alias("n"), F.min("point_id").alias("first"), F.max("point_id").alias("last"), F.sum("point_id").alias("total"))


@query(f"{_P} select point_id, {q6('z')} as z from points where scan_id = 1")
def point_maps(spark, sf_dir):
    """Point maps as columns of a table by scan: one column of one scan is all that is read."""
    from habitrace.session import new_path

    path = new_path(spark, "maps")
    room_points(spark, sf_dir).write.partitionBy("scan_id").parquet(path)
    return spark.read.parquet(path).filter("scan_id = 1").select("point_id", r6("z").alias("z"))


@query("select name from (values ('pages.parquet'), ('part.parquet')) v(name)")
def object_listing(spark, sf_dir):
    """Objects under a prefix, listed by the file source; their contents aren't read. A folder of files is one object."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/p*.parquet")
    return files.select(F.regexp_extract("path", r"/(p[^/]*\.parquet)(/|$)", 1).alias("name")).distinct()


@query(f"{_P} select point_id, x, y, z from points where z between 0.10 and 1.80 and isfinite(x) and isfinite(y) and isfinite(z)")
def height_band(spark, sf_dir):
    """Finite points within the height band, both ends included."""
    from habitrace.operators import spatial

    return room_points(spark, sf_dir).filter(spatial.finite("x", "y", "z") & spatial.height_band("z")).select("point_id", "x", "y", "z")
