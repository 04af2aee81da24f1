"""Risk levels, scores and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitrace.operators import exact, rules
from habitrace.plans.define import d6, q6, query, r6
from habitrace.sources.driver_tables import table

#: How event types stand for rule codes: (type, code, factor).
CODES = [("view", "door_width", 0.02), ("click", "passage_width", 0.03), ("error", "threshold", 0.0003), ("signup", "slope", 0.0008), ("purchase", "uneven", 0.0003)]


def measures(spark: SparkSession, sf_dir: str, support: int = 12) -> DataFrame:
    """(scan_id, code, value): averages with enough support, else NULL."""
    codes = spark.createDataFrame(CODES, "event_type string, code string, factor double")
    events = exact.added(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")
    seen = events.groupBy(F.col("user_id").alias("scan_id"), "event_type").agg(exact.mean_in_order("value").alias("v"), F.count("*").alias("n"))
    return seen.join(F.broadcast(codes), "event_type").select("scan_id", "code", rules.eligible_value(F.col("v") * F.col("factor"), F.col("n") >= support).alias("value"))


def _base(support: int = 12) -> str:
    codes = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in CODES)
    return f"""with {rules.rules_sql()}, codes(event_type, code, factor) as (values {codes}),
m as (select e.user_id as scan_id, c.code, case when count(*) >= {support} then avg(e.value) * any_value(c.factor) end as value from events e join codes c using (event_type) group by 1, 2),
lv as (select s.scan_id, r.code, r.place, r.category, r.weight, m.value, {rules.LEVEL_SQL.replace("value", "m.value")} as level
  from (select distinct scan_id from m) s cross join rules r left join m on m.scan_id = s.scan_id and m.code = r.code),
cat as (select scan_id, category, weight, min(case level when 'green' then 1.0 when 'yellow' then 0.5 when 'red' then 0.0 end)::double as v, count(*) filter (where level <> 'unknown') as known, count(*) as total from lv group by all),
sc as (select scan_id, 100 * sum(weight::double * v) / nullif(sum(case when v is not null then weight::double end), 0) as score, sum(known)::bigint as known, sum(total)::bigint as total from cat group by 1)
"""


def _levels(spark: SparkSession, sf_dir: str, support: int = 12) -> DataFrame:
    return rules.evaluate(measures(spark, sf_dir, support), rules.rule_table(spark))


@query(_base() + f"select scan_id, code, category, level, {q6('value')} as value from lv")
def risk_levels(spark, sf_dir):
    return _levels(spark, sf_dir).select("scan_id", "code", "category", "level", d6("value").alias("value"))


@query(_base() + f"select scan_id, {q6('score')} as score, known, total from sc")
def risk_score(spark, sf_dir):
    return rules.score(_levels(spark, sf_dir)).select("scan_id", d6("score").alias("score"), "known", "total")


@query(_base(20) + f"select scan_id, {q6('score')} as score, {q6('100.0 * known / total')} as completeness from sc")
def risk_completeness(spark, sf_dir):
    """A stricter support gate: scans without any trusted measure have no score."""
    return rules.score(_levels(spark, sf_dir, 20)).select("scan_id", d6("score").alias("score"), d6("completeness").alias("completeness"))


@query(_base() + "select scan_id, string_agg(code, '; ' order by place) as advice, count(*) as n from lv where level in ('red', 'yellow') group by 1")
def risk_advice(spark, sf_dir):
    worst = _levels(spark, sf_dir).filter(F.col("level").isin("red", "yellow"))
    listed = worst.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("c"), F.count("*").alias("n"))
    return listed.select("scan_id", F.array_join(F.col("c.code"), "; ").alias("advice"), "n")


@query(_base() + "select category, level, count(*) as n, count(distinct scan_id) as scans from lv group by 1, 2")
def risk_status_counts(spark, sf_dir):
    return _levels(spark, sf_dir).groupBy("category", "level").agg(F.count("*").alias("n"), F.countDistinct("scan_id").alias("scans"))


@query(
    """with s as (select o_custkey as project_id, o_orderkey as scan_id, o_totalprice as score, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders)
select a.project_id, a.scan_id as before_id, b.scan_id as after_id, round(b.score - a.score, 6) + 0.0 as delta from s a join s b on a.project_id = b.project_id and b.k = a.k + 1"""
)
def scan_compare_delta(spark, sf_dir):
    """Each scan against the one before of its project; one pass over a window instead of a self join."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.lag("o_orderkey").over(w).alias("before_id"), F.col("o_orderkey").alias("after_id"), r6(F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("delta"))
    return rows.filter("before_id is not null")


@query(_base() + "select level, case level when 'red' then 'box' when 'yellow' then 'arrow' when 'unknown' then null else 'segment' end as kind, count(*) as n from lv group by 1, 2")
def risk_geometry_kinds(spark, sf_dir):
    kind = F.when(F.col("level") == "red", "box").when(F.col("level") == "yellow", "arrow").when(F.col("level") == "green", "segment")
    return _levels(spark, sf_dir).groupBy("level", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(_base() + "select scan_id, case when score is null then 'none' when score >= 80 then 'good' when score >= 60 then 'fair' else 'poor' end as band from sc")
def risk_bands(spark, sf_dir):
    s = F.col("score")
    return rules.score(_levels(spark, sf_dir)).select("scan_id", F.when(s.isNull(), "none").when(s >= 80, "good").when(s >= 60, "fair").otherwise("poor").alias("band"))
