"""Relational operators: precedence, overrides, integrity, hierarchy, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import table


def _hierarchy(spark, sf_dir):
    """scans -> projects -> organisations -> regions; the upper tables are a few rows each."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    orgs = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(orgs), F.col("c_nationkey") == F.col("n_nationkey"))


_H = "from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey"


@query(f"select r_name as region, n_name as org, count(*) as scans, {q6('avg(o_totalprice)')} as score {_H} group by rollup (r_name, n_name)")
def hierarchy_rollup(spark, sf_dir):
    return _hierarchy(spark, sf_dir).rollup(F.col("r_name").alias("region"), F.col("n_name").alias("org")).agg(F.count("*").alias("scans"), r6(F.avg("o_totalprice")).alias("score"))


@query(f"select r_name as region, o_orderstatus as status, count(*) as scans {_H} group by cube (r_name, o_orderstatus)")
def hierarchy_cube(spark, sf_dir):
    return _hierarchy(spark, sf_dir).cube(F.col("r_name").alias("region"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("scans"))


@query(f"select r_name as region, c_mktsegment as segment, o_orderpriority as priority, count(*) as scans {_H} group by grouping sets ((r_name, c_mktsegment), (o_orderpriority), ())")
def grouping_sets(spark, sf_dir):
    h = _hierarchy(spark, sf_dir).select(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"))
    region, segment, priority = F.col("region"), F.col("segment"), F.col("priority")
    return h.groupingSets([[region, segment], [priority], []], region, segment, priority).agg(F.count("*").alias("scans"))


@query("select o_orderkey as scan_id, c_custkey as project_id, n_name as org " + _H + " where r_name = 'ASIA'")
def org_scoped_scans(spark, sf_dir):
    """The access predicate: only rows of one organisation's region are seen."""
    return _hierarchy(spark, sf_dir).filter("r_name = 'ASIA'").select(F.col("o_orderkey").alias("scan_id"), F.col("c_custkey").alias("project_id"), F.col("n_name").alias("org"))


@query("select l_orderkey as scan_id, l_linenumber as object_id from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F' and o_totalprice > 1000)")
def semi_eligible(spark, sf_dir):
    ok = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_totalprice > 1000").select("o_orderkey")
    l = table(spark, sf_dir, "lineitem")
    return l.join(ok, l.l_orderkey == ok.o_orderkey, "left_semi").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("object_id"))


@query("select c_custkey as project_id, c_name as name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def anti_unattached(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_custkey")
    c = table(spark, sf_dir, "customer")
    return c.join(urgent, c.c_custkey == urgent.o_custkey, "left_anti").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))


@query(
    """with u as (select l_partkey as id, 1 as src, l_extendedprice as v, l_orderkey * 10 + l_linenumber as k from lineitem where l_returnflag = 'R' union all select l_partkey, 2, l_extendedprice, l_orderkey * 10 + l_linenumber from lineitem where l_returnflag = 'A' union all select p_partkey, 3, p_retailprice, 0 from part),
n as (select *, row_number() over (partition by id order by src, k) as r from u) select id, src, v as value from n where r = 1"""
)
def first_match_precedence(spark, sf_dir):
    """Instances before objects before the catalogue: a minimum over the rank, not a sort of each group."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    src = F.when(F.col("l_returnflag") == "R", 1).otherwise(2)
    u = l.filter("l_returnflag in ('R', 'A')").select(F.col("l_partkey").alias("id"), src.alias("src"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_extendedprice").alias("v"))
    u = u.union(p.select("p_partkey", F.lit(3), F.lit(0).cast("bigint"), "p_retailprice"))
    return u.groupBy("id").agg(F.min(F.struct("src", "k", "v")).alias("b")).select("id", "b.src", F.col("b.v").alias("value"))


@query("select o.o_orderkey as scan_id, coalesce(l.v, o.o_totalprice) as value, l.v is not null as fresh from orders o left join (select l_orderkey, max(l_extendedprice) as v from lineitem where l_linestatus = 'O' group by 1) l on l.l_orderkey = o.o_orderkey")
def stale_override(spark, sf_dir):
    """The current file beats the stored snapshot."""
    now = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("v"))
    o = table(spark, sf_dir, "orders")
    return o.join(now, o.o_orderkey == now.l_orderkey, "left").select(F.col("o_orderkey").alias("scan_id"), F.coalesce("v", "o_totalprice").alias("value"), F.col("v").isNotNull().alias("fresh"))


@query(
    """with p as (select o_custkey as id, max(o_totalprice) as v from orders where o_orderstatus = 'O' group by 1), d as (select distinct o_custkey as id from orders where o_orderpriority like '5%' and o_totalprice < 2000)
select coalesce(c.c_custkey, p.id) as id, coalesce(p.v, c.c_acctbal) as value, c.c_custkey is not null and p.id is not null as patched from customer c full join p on p.id = c.c_custkey where coalesce(c.c_custkey, p.id) not in (select id from d)"""
)
def override_merge(spark, sf_dir):
    """Patch, add and drop by id."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    patch = o.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v"))
    drop = o.filter(F.col("o_orderpriority").startswith("5") & (F.col("o_totalprice") < 2000)).select(F.col("o_custkey").alias("id")).distinct()
    base = c.select(F.col("c_custkey").alias("id"), "c_acctbal", F.lit(True).alias("stored"))
    merged = base.join(patch, "id", "full").join(drop, "id", "left_anti")
    return merged.select("id", F.coalesce("v", "c_acctbal").alias("value"), (F.coalesce("stored", F.lit(False)) & F.col("v").isNotNull()).alias("patched"))


@query("select o_custkey as project_id, max_by(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) as report_id, max(o_orderdate) as created_at, count(*) as attempts from orders group by 1")
def latest_upsert(spark, sf_dir):
    """Idempotent retries: the latest report of each project wins."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("report_id"), F.max("o_orderdate").alias("created_at"), F.count("*").alias("attempts"))


@query("select o_custkey as project_id, o_orderdate as day, count(*) as n from orders group by 1, 2 having count(*) > 1")
def integrity_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("day")).agg(F.count("*").alias("n")).filter("n > 1")


@query("select c_nationkey as org_id, count(*) filter (where c_mktsegment = 'BUILDING') as admins from customer group by 1 having count(*) filter (where c_mktsegment = 'BUILDING') <> 1")
def single_admin(spark, sf_dir):
    """Organisations that break the one-admin rule."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("org_id")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("admins")).filter("admins <> 1")


@query("select o_orderkey as scan_id, o_custkey as project_id, o_orderstatus as status from orders order by o_orderkey desc limit 20 offset 40")
def paginated_projects(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("status")).orderBy(F.desc("scan_id")).offset(40).limit(20)


def _ids(spark, sf_dir, kind):
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select(F.col("user_id").alias("scan_id"), F.floor("value").alias("point_id"))


def _set(op: str) -> str:
    part = lambda k: f"select user_id as scan_id, floor(value)::bigint as point_id from events where event_type = '{k}'"
    return f"{part('view')} {op} {part('click')}"


@query(_set("union"))
def set_union(spark, sf_dir):
    return _ids(spark, sf_dir, "view").union(_ids(spark, sf_dir, "click")).distinct()


@query(_set("intersect"))
def set_intersect(spark, sf_dir):
    return _ids(spark, sf_dir, "view").intersect(_ids(spark, sf_dir, "click"))


@query(_set("except"))
def set_except(spark, sf_dir):
    return _ids(spark, sf_dir, "view").subtract(_ids(spark, sf_dir, "click"))


@query("select c_mktsegment as segment, count(*) as n, count(distinct c_nationkey) as orgs, round(avg(c_acctbal), 6) + 0.0 as mean from customer group by 1")
def counts_by_category(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("orgs"), r6(F.avg("c_acctbal")).alias("mean"))


@query("select o_orderkey as scan_id, case when l.n is null then 'unavailable' else 'ok' end as status, coalesce(l.n, 0) as objects from orders o left join (select l_orderkey, count(*) as n from lineitem where l_quantity > 30 group by 1) l on l.l_orderkey = o.o_orderkey")
def degrade_unavailable(spark, sf_dir):
    """A stage without output leaves its scans 'unavailable' and keeps their rows."""
    stage = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders")
    return o.join(stage, o.o_orderkey == stage.l_orderkey, "left").select(F.col("o_orderkey").alias("scan_id"), F.when(F.col("n").isNull(), "unavailable").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("objects"))


@query("select o_orderkey as scan_id, n_name as org, r_name as region, s.n_objects from (select o_orderkey, o_custkey from orders where o_totalprice > 5000) o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey join (select l_orderkey, count(*) as n_objects from lineitem group by 1) s on s.l_orderkey = o.o_orderkey")
def scan_overview(spark, sf_dir):
    objects = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_objects"))
    h = _hierarchy(spark, sf_dir).filter("o_totalprice > 5000")
    return h.join(objects, h.o_orderkey == objects.l_orderkey).select(F.col("o_orderkey").alias("scan_id"), F.col("n_name").alias("org"), F.col("r_name").alias("region"), "n_objects")


@query(f"select l.l_orderkey as scan_id, s.s_nationkey as org_id, count(*) as n, {q6('sum(l_extendedprice * (1 - l_discount))')} as net from lineitem l join supplier s on l.l_suppkey = s.s_suppkey group by 1, 2")
def scan_org_totals(spark, sf_dir):
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return l.join(s, l.l_suppkey == s.s_suppkey).groupBy(F.col("l_orderkey").alias("scan_id"), F.col("s_nationkey").alias("org_id")).agg(F.count("*").alias("n"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("net"))
