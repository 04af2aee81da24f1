"""Measurements: gates, scales, dimensions, coverage, upserts of measured rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import scale
from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import table


def _objects(spark, sf_dir):
    """Measured objects: quantity stands for views, discount for plausibility, tax for readiness."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"), F.col("l_partkey").alias("part_id"), F.col("l_extendedprice").alias("size"),
        F.when(F.col("l_linestatus") == "F", "stable").otherwise("incomplete").alias("status"), (F.col("l_quantity") / 10).alias("views"), (F.col("l_discount") <= 0.07).alias("plausible"), (F.col("l_tax") <= 0.06).alias("ready"),
    )


_OBJECTS = """o as (select l_orderkey as scan_id, l_linenumber as object_id, l_partkey as part_id, l_extendedprice as size, case when l_linestatus = 'F' then 'stable' else 'incomplete' end as status,
 l_quantity / 10 as views, l_discount <= 0.07 as plausible, l_tax <= 0.06 as ready from lineitem),
g as (select *, case when status <> 'stable' then 'instance_not_stable' when views < 2 then 'too_few_views' when not plausible then 'implausible' when not ready then 'not_measurement_ready' end as reason from o)"""


def _gated(spark, sf_dir):
    c = F.col
    return _objects(spark, sf_dir).withColumn("reason", scale.gate_reason(c("status"), c("views"), c("plausible"), c("ready")))


@query(f"with {_OBJECTS} select scan_id, object_id, reason, case when reason is null then size end as value from g")
def measurement_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("scan_id", "object_id", "reason", F.when(F.col("reason").isNull(), F.col("size")).alias("value"))


@query(f"with {_OBJECTS} select scan_id, count(*) as total, count(*) filter (where reason is null) as verified, {q6('100.0 * count(*) filter (where reason is null) / count(*)')} as coverage from g group by 1")
def measurement_coverage(spark, sf_dir):
    ok = F.count_if(F.col("reason").isNull())
    return _gated(spark, sf_dir).groupBy("scan_id").agg(F.count("*").alias("total"), ok.alias("verified"), r6(100.0 * ok / F.count("*")).alias("coverage"))


@query(f"with {_OBJECTS} select coalesce(reason, 'verified') as reason, count(*) as n from g group by 1")
def gate_reasons(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("verified")).alias("reason")).agg(F.count("*").alias("n"))


_REF = "ref as (select l_orderkey as scan_id, l_linenumber as ref_id, p.p_retailprice / nullif(l.l_extendedprice / l.l_quantity, 0) * (1 + l_discount * 8) as s, l_linenumber > 3 as held_out from lineitem l join part p on l.l_partkey = p.p_partkey)"


def _references(spark, sf_dir):
    """Scale candidates: known length over measured length; the fourth and later of a scan are held out."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    measured = F.col("l_extendedprice") / F.col("l_quantity")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("ref_id"), (F.try_divide(F.col("p_retailprice"), measured) * (1 + F.col("l_discount") * 8)).alias("s"), (F.col("l_linenumber") > 3).alias("held_out"))


@query(
    f"""with {_REF}, u as (select scan_id, count(*) as n, quantile_cont(s, 0.5) as med, max(s) as hi, min(s) as lo from ref where not held_out group by 1)
select scan_id, n, {q6("case when (hi - lo) / med > 0.5 and n > 1 then null else med end")} as scale, case when (hi - lo) / med > 0.5 and n > 1 then 'failed' when n = 1 then 'low' else 'ok' end as status from u"""
)
def reference_scale(spark, sf_dir):
    use = _references(spark, sf_dir).filter(~F.col("held_out"))
    per = use.groupBy("scan_id").agg(F.count("*").alias("n"), F.median("s").alias("med"), F.max("s").alias("hi"), F.min("s").alias("lo"))
    failed = ((F.col("hi") - F.col("lo")) / F.col("med") > 0.5) & (F.col("n") > 1)
    return per.select("scan_id", "n", r6(F.when(~failed, F.col("med"))).alias("scale"), F.when(failed, "failed").when(F.col("n") == 1, "low").otherwise("ok").alias("status"))


@query(
    f"""with {_REF}, p as (select c.scan_id, c.ref_id as i, count(*) as used, quantile_cont(o.s, 0.5) as m from ref c join ref o on c.scan_id = o.scan_id and abs(o.s - c.s) <= 0.25 * c.s group by 1, 2),
b as (select *, row_number() over (partition by scan_id order by used desc, i) as k, count(*) over (partition by scan_id) as n from p)
select scan_id, n, used, {q6("case when used >= 2 then m end")} as scale from b where k = 1"""
)
def scale_consensus(spark, sf_dir):
    found = scale.consensus_scale(_references(spark, sf_dir), "scan_id", "s", "ref_id")
    return found.withColumn("scale", r6("scale"))


@query(
    f"""with {_REF}, u as (select scan_id, quantile_cont(s, 0.5) as med from ref where not held_out group by 1)
select scan_id, count(*) as n, {q6("avg(abs(r.s - u.med) / u.med)")} as mean_error, {q6("max(abs(r.s - u.med) / u.med)")} as max_error from ref r join u using (scan_id) where r.held_out group by 1"""
)
def holdout_error(spark, sf_dir):
    refs = _references(spark, sf_dir)
    used = refs.filter(~F.col("held_out")).groupBy("scan_id").agg(F.median("s").alias("med"))
    error = F.abs(F.col("s") - F.col("med")) / F.col("med")
    return refs.filter("held_out").join(used, "scan_id").groupBy("scan_id").agg(F.count("*").alias("n"), r6(F.avg(error)).alias("mean_error"), r6(F.max(error)).alias("max_error"))


@query("select p_partkey as object_id, round(p_size * 0.0254::double, 6) + 0.0 as size_m, round(p_retailprice * 0.001 * 1.37, 6) + 0.0 as length_m, round(greatest(p_size * 0.0254::double, 0.3), 6) + 0.0 as opening_m from part")
def scaled_dimensions(spark, sf_dir):
    size = F.col("p_size") * 0.0254
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), r6(size).alias("size_m"), r6(F.col("p_retailprice") * 0.001 * 1.37).alias("length_m"), r6(F.greatest(size, F.lit(0.3))).alias("opening_m"))


@query("select l_orderkey as scan_id, l_linenumber as object_id, greatest(l_quantity, l_tax * 100) as length, least(l_quantity, l_tax * 100) as width, l_discount * 10 as height from lineitem where l_returnflag = 'R'")
def opening_dims(spark, sf_dir):
    a, b = F.col("l_quantity"), F.col("l_tax") * 100
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"), F.greatest(a, b).alias("length"), F.least(a, b).alias("width"), (F.col("l_discount") * 10).alias("height"))


@query("select l_orderkey as scan_id, l_linenumber as object_id, round(l_quantity / nullif(l_discount * 100, 0) * 2.0, 6) + 0.0 as width_m from lineitem where l_returnflag = 'A'")
def door_aspect(spark, sf_dir):
    """Width recovered from the aspect ratio and a known height; a zero height gives NULL."""
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"), r6(F.try_divide(F.col("l_quantity"), F.col("l_discount") * 100) * 2.0).alias("width_m"))


@query("select l_orderkey as scan_id, l_linenumber as object_id, case when l_tax is null then null when l_tax * 10 >= 0.45 then 'normal' when l_tax * 10 >= 0.30 then 'sideways' else 'not_passable' end as class from lineitem")
def passability_class(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"), scale.passability(F.col("l_tax") * 10).alias("class"))


@query("select l_orderkey as scan_id, l_linenumber as object_id, round((0.45 * least(l_quantity * 20 / 500.0, 1) + 0.35 * greatest(least((1 - l_discount * 5) / 0.7, 1), 0) + 0.2 * case when l_tax <= 0.06 then 1 else 0 end) * (0.6 + 0.4 * (1 - l_tax)), 6) + 0.0 as confidence from lineitem")
def geometry_confidence(spark, sf_dir):
    clip = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    base = 0.45 * F.least(F.col("l_quantity") * 20 / 500.0, F.lit(1.0)) + 0.35 * clip((1 - F.col("l_discount") * 5) / 0.7) + 0.2 * F.when(F.col("l_tax") <= 0.06, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"), r6(base * (0.6 + 0.4 * (1 - F.col("l_tax")))).alias("confidence"))


@query(
    """with f as (select o_orderkey as scan_id, o_custkey as project_id, o_totalprice from orders), p as (select l_orderkey as scan_id, max_by(l_linenumber, {'a': l_quantity, 'b': -l_linenumber}) as best, max(l_quantity) as views from lineitem where l_linestatus = 'O' group by 1)
select f.scan_id, p.best as object_id, p.views, p.scan_id is not null as forced from f left join p using (scan_id)"""
)
def forced_estimates(spark, sf_dir):
    """The best unverified object per scan, flagged and never risk-eligible."""
    best = F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber")))
    p = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("scan_id")).agg(best.alias("object_id"), F.max("l_quantity").alias("views"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id")).join(p, "scan_id", "left").select("scan_id", "object_id", "views", F.col("views").isNotNull().alias("forced"))


@query(
    f"""with {_OBJECTS}, ok as (select scan_id, min({{'o': object_id, 's': size}}) as d, avg(size) as passage from g where reason is null group by 1)
select distinct g.scan_id, ok.d.o as door, {q6('ok.d.s')} as door_width, {q6('ok.passage')} as passage from g left join ok using (scan_id)"""
)
def risk_inputs(spark, sf_dir):
    """The first verified eligible object per scan; without one every input is unknown (NULL)."""
    g = _gated(spark, sf_dir)
    ok = F.col("reason").isNull()
    first = F.min(F.when(ok, F.struct("object_id", "size")))
    per = g.groupBy("scan_id").agg(first.alias("d"), r6(F.avg(F.when(ok, F.col("size")))).alias("passage"))
    return per.select("scan_id", F.col("d.object_id").alias("door"), r6("d.size").alias("door_width"), "passage")
