"""Stage documents of several versions, read by declared kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import documents
from habitrace.operators.documents import Field
from habitrace.plans.define import query
from habitrace.sources.driver_tables import table

#: A scan's document: version 1 has sizes as text, version 2 leaves out the status of every third, version 3 writes null notes; every eleventh is cut short.
_SCAN = [Field("version", "$.schema_version", "long", 0), Field("status", "$.state.status", "string", "unknown"), Field("price", "$.price", "double", -1.0), Field("note", "$.note", "string", "none"), Field("urgent", "$.state.urgent", "boolean", False)]
_ITEM = [Field("label", "$.label", "string", "?"), Field("size", "$.size", "double"), Field("line", "$.id", "long", -1)]

_VERSION = "o_orderkey % 3 + 1"


def _documents(spark, sf_dir):
    """(scan_id, version_told, document): a document an order, its lines the objects of the scan."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key, version = F.col("scan_id"), F.col("version_told")
    size = F.col("l_quantity").cast("int").cast("string")
    item = F.concat(
        F.lit('{"id":'), F.col("l_linenumber").cast("string"), F.lit(',"label":"'), F.lower("l_returnflag"), F.lit('"'),
        F.when(version == 1, F.concat(F.lit(',"size":"'), size, F.lit('"'))).when((version == 2) & (F.col("l_linenumber") % 2 == 0), F.lit("")).otherwise(F.concat(F.lit(',"size":'), size)), F.lit("}"),
    )
    lines = line.withColumn("scan_id", F.col("l_orderkey")).withColumn("version_told", F.expr("l_orderkey % 3 + 1"))
    objects = lines.groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", F.col("l_quantity").cast("int").alias("q"), item.alias("i")))), lambda s: s["i"]), ",").alias("objects"))
    rows = o.select(F.col("o_orderkey").alias("scan_id"), F.expr(_VERSION).alias("version_told"), "o_orderstatus", F.col("o_totalprice").cast("int").cast("string").alias("price"), "o_orderpriority").join(objects, "scan_id", "left")
    status = F.when((version == 2) & (key % 9 == 1), F.lit("")).otherwise(F.concat(F.lit('"status":"'), F.col("o_orderstatus"), F.lit('",')))
    text = F.concat(
        F.lit('{"schema_version":'), version.cast("string"), F.lit(',"state":{'), status, F.lit('"urgent":'), F.when(version == 3, F.lit('"yes"')).otherwise(F.col("o_orderpriority").startswith("1").cast("string")), F.lit('},"price":'), F.col("price"),
        F.when(version == 3, F.lit(',"note":null')).otherwise(F.concat(F.lit(',"note":'), key.cast("string"))), F.lit(',"objects":'), F.when(F.col("objects").isNull(), F.lit("{}")).otherwise(F.concat(F.lit("["), F.col("objects"), F.lit("]"))), F.lit("}"),
    )
    return documents.parsed(rows.select("scan_id", "version_told", F.when(key % 11 == 0, F.substring(text, 1, 20)).otherwise(text).alias("document")))


_ROWS = f"o as (select o_orderkey as scan_id, ({_VERSION})::bigint as v, o_orderkey % 11 <> 0 as readable, o_orderstatus, trunc(o_totalprice)::double as price, o_orderpriority like '1%' as urgent from orders)"


@query(
    f"""with {_ROWS} select scan_id, readable, case when readable then v else 0 end as version, case when readable then 'ok' else 'missing' end as version_state,
case when readable and not (v = 2 and scan_id % 9 = 1) then o_orderstatus else 'unknown' end as status, case when readable and not (v = 2 and scan_id % 9 = 1) then 'ok' else 'missing' end as status_state,
case when readable then price else -1.0 end as price, case when readable then 'ok' else 'missing' end as price_state,
case when readable and v <> 3 then scan_id::varchar else 'none' end as note, case when not readable then 'missing' when v = 3 then 'null' else 'ok' end as note_state,
readable and v <> 3 and urgent as urgent, case when not readable then 'missing' when v = 3 then 'mistyped' else 'ok' end as urgent_state from o"""
)
def stage_fields(spark, sf_dir):
    """Fields of documents of three versions: values by declared kind, defaults and why they stand."""
    return documents.fields(_documents(spark, sf_dir), _SCAN).drop("version_told")


@query(
    "select l_orderkey as scan_id, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, trunc(l_quantity)) - 1 as pos, lower(l_returnflag) as label, 'ok' as label_state, case when l_orderkey % 3 = 0 or l_orderkey % 3 = 1 and l_linenumber % 2 = 0 then null else trunc(l_quantity)::double end as size, case when l_orderkey % 3 = 0 then 'mistyped' when l_orderkey % 3 = 1 and l_linenumber % 2 = 0 then 'missing' else 'ok' end as size_state, l_linenumber::bigint as line, 'ok' as line_state from lineitem where l_orderkey % 11 <> 0 and exists (select 1 from orders where o_orderkey = l_orderkey)"
)
def stage_objects(spark, sf_dir):
    """The objects inside the documents, one row each."""
    return documents.items(_documents(spark, sf_dir), "$.objects", _ITEM, ["scan_id"])


@query(
    f"""with {_ROWS}, s as (select v as version_told, 'version' as field, case when readable then 'ok' else 'missing' end as state from o union all select v, 'price', case when readable then 'ok' else 'missing' end from o
union all select v, 'status', case when readable and not (v = 2 and scan_id % 9 = 1) then 'ok' else 'missing' end from o union all select v, 'note', case when not readable then 'missing' when v = 3 then 'null' else 'ok' end from o
union all select v, 'urgent', case when not readable then 'missing' when v = 3 then 'mistyped' else 'ok' end from o)
select version_told, field, count(*) as n, count(*) filter (where state = 'ok') as ok, count(*) filter (where state = 'missing') as missing, count(*) filter (where state = 'null') as nulls, count(*) filter (where state = 'mistyped') as mistyped from s group by 1, 2"""
)
def stage_drift(spark, sf_dir):
    """How many documents of each version hold each field as declared."""
    return documents.drift(_documents(spark, sf_dir), _SCAN, ["version_told"])


@query(
    f"""with {_ROWS} select v as version_told, count(*) as n, case v when 1 then 'OBJECT<note: BIGINT, objects: ARRAY<OBJECT<id: BIGINT, label: STRING, size: STRING>>, price: BIGINT, schema_version: BIGINT, state: OBJECT<status: STRING, urgent: BOOLEAN>>'
when 2 then 'OBJECT<note: BIGINT, objects: ARRAY<OBJECT<id: BIGINT, label: STRING, size: BIGINT>>, price: BIGINT, schema_version: BIGINT, state: OBJECT<status: STRING, urgent: BOOLEAN>>'
else 'OBJECT<note: VOID, objects: ARRAY<OBJECT<id: BIGINT, label: STRING, size: BIGINT>>, price: BIGINT, schema_version: BIGINT, state: OBJECT<status: STRING, urgent: STRING>>' end as layout from o where readable and exists (select 1 from lineitem where l_orderkey = scan_id) group by 1"""
)
def stage_layouts(spark, sf_dir):
    """The layout that the readable documents of each version share."""
    whole = _documents(spark, sf_dir).filter("readable").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id")).distinct(), "scan_id", "left_semi")
    return documents.schemas(whole, ["version_told"])
