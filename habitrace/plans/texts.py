"""Layout text, logs and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.functions import text
from habitrace.plans.define import query
from habitrace.sources import layout_text
from habitrace.sources.driver_tables import table


def _layout_lines(spark, sf_dir):
    """Layout lines spelled from measured objects; every fifth is malformed."""
    l = table(spark, sf_dir, "lineitem")
    wall = F.concat(F.lit("wall_"), F.col("l_linenumber"), F.lit("=Wall("), F.concat_ws(", ", *(F.lit(v) if isinstance(v, str) else v for v in ("0", "0", "0", F.floor("l_quantity").cast("string"), "0", "0", "2.5", "0.1"))), F.lit(")"))
    door = F.concat(F.lit("door_"), F.col("l_linenumber"), F.lit("=Door(wall_"), F.col("l_linenumber") - 1, F.lit(", 1, 0, 1, 0.9, 2)"))
    line = F.when(F.col("l_orderkey") % 5 == 0, F.lit("wall_x=Wall(broken")).when(F.col("l_returnflag") == "R", door).otherwise(wall)
    return l.select(F.col("l_orderkey").alias("scan_id"), line.alias("line"))


_LINES = """lines as (select l_orderkey as scan_id, case when l_orderkey % 5 = 0 then 'wall_x=Wall(broken' when l_returnflag = 'R' then 'door_' || l_linenumber || '=Door(wall_' || (l_linenumber - 1) || ', 1, 0, 1, 0.9, 2)'
 else 'wall_' || l_linenumber || '=Wall(0, 0, 0, ' || floor(l_quantity)::bigint || ', 0, 0, 2.5, 0.1)' end as line from lineitem),
pl as (select scan_id, regexp_extract(line, '(wall|door)_([0-9]+)=[A-Z][a-z]+[(]([^()]*)[)]', 1) as kind, try_cast(regexp_extract(line, '(wall|door)_([0-9]+)=[A-Z][a-z]+[(]([^()]*)[)]', 2) as int) as item_id, string_split(regexp_extract(line, '(wall|door)_([0-9]+)=[A-Z][a-z]+[(]([^()]*)[)]', 3), ', ') as args from lines)"""


@query(f"with {_LINES} select scan_id, item_id, args[4]::double as length, args[7]::double as height from pl where kind = 'wall'")
def layout_parse(spark, sf_dir):
    w = layout_text.walls(layout_text.parse_layout(_layout_lines(spark, sf_dir)))
    return w.select("scan_id", "item_id", F.col("bx").alias("length"), "height")


@query(f"with {_LINES}, w as (select scan_id, item_id from pl where kind = 'wall') select d.scan_id, d.item_id, w.item_id as wall_id, d.args[5]::double as width from pl d join w on w.scan_id = d.scan_id and 'wall_' || w.item_id = d.args[1] where d.kind = 'door'")
def layout_openings(spark, sf_dir):
    parsed = layout_text.parse_layout(_layout_lines(spark, sf_dir))
    return layout_text.openings(parsed, layout_text.walls(parsed), ["scan_id"]).select("scan_id", "item_id", "wall_id", "width")


@query(r"select page_id, regexp_replace(regexp_replace(url || '&token=' || page_id || ' done', '(?i)(token|password|secret|key)=([^ &\n]+)', '\1=***', 'g'), '(?i)(https?://)[^/ \n]+', '\1<host>', 'g') as line from pages")
def log_redact(spark, sf_dir):
    line = F.concat(F.col("url"), F.lit("&token="), F.col("page_id").cast("string"), F.lit(" done"))
    return table(spark, sf_dir, "pages").select("page_id", text.redacted(line).alias("line"))


@query("select event_id, case when value < 1 then null else round(event_id % 100 / floor(value), 6) + 0.0 end as share from events")
def progress_parse(spark, sf_dir):
    line = F.when(F.col("value") < 1, "starting").otherwise(F.concat(F.lit("frame "), (F.col("event_id") % 100).cast("string"), F.lit("/"), F.floor("value").cast("string"), F.lit(" ok")))
    return table(spark, sf_dir, "events").select("event_id", (F.round(text.progress(line), 6) + F.lit(0.0)).alias("share"))


#: Prompts in order of precedence.
PROMPTS = [("the", "article"), ("de", "romance"), ("und", "german")]


@query("select doc_id, case when contains(t, 'the') then 'article' when contains(t, 'de') then 'romance' when contains(t, 'und') then 'german' else 'other' end as label from (select doc_id, trim(regexp_replace(replace(lower(text), '.', ' '), ' +', ' ', 'g')) as t from documents)")
def label_from_text(spark, sf_dir):
    """Labels from whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normal_label(F.col("text"), PROMPTS, "other").alias("label"))


@query("select page_id, regexp_extract(url, '[^/]+$') as name from pages")
def filename_safe(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("select p_partkey as object_id, case when p_size % 7 = 0 then '-' else printf('%.2f', (p_size / 7.3)::double) end as shown, case when p_size % 2 = 0 then 'yes' else 'no' end as even from part")
def number_format(spark, sf_dir):
    value = F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 7.3)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), text.shown(value).alias("shown"), F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no").alias("even"))


@query("select page_id, sha256(url) as digest from pages")
def provenance_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("digest"))


@query("select conv_id, count(*) as turns, count(*) filter (where role = 'assistant') as replies, max(length(text))::bigint as longest from conversations group by 1")
def message_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("replies"), F.max(F.length("text")).cast("bigint").alias("longest"))
