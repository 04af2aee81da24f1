"""Rows behind plans and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import drawing
from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import ROOM_BOXES_SQL, room_boxes

_B = f"with {ROOM_BOXES_SQL}, b as (select *, box_id % 10 as part, box_id % 4 * 90 + case when box_id % 3 = 0 then yaw else 0 end as degrees, 'kind' || label as name from boxes)"


def _parts(spark, sf_dir):
    """Boxes in roles by the last digit of their id: 0 an opening, 1 an obstacle, 9 attached to the one before, else an object."""
    turned = F.col("box_id") % 4 * 90 + F.when(F.col("box_id") % 3 == 0, F.col("yaw")).otherwise(0.0)
    return room_boxes(spark, sf_dir).withColumns({"part": F.col("box_id") % 10, "degrees": turned, "name": F.concat(F.lit("kind"), F.col("label").cast("string"))})


_SIDE = {"floor": ("2.0", "2.0", "0"), "opening": ("case when up then 0.09 else sx / 2 end", "case when up then sx / 2 else 0.09 end", "0"), "object": ("sx / 2", "sy / 2", "degrees"), "obstacle": ("greatest(sx, sy) / 2", "least(sx, sy) / 2", "degrees")}


def _layer(name: str) -> str:
    hx, hy, deg = _SIDE[name]
    source = {"floor": "(select distinct scan_id, 0 as box_id, 0.0 as cx, 0.0 as cy, 0.0 as sx, 0.0 as sy, 0.0 as degrees, null as name from b)", "opening": "(select *, round_even(degrees, 0) % 180 = 90 as up from b where part = 0)", "object": "(select * from b where part between 2 and 8)", "obstacle": "(select * from b where part = 1 and least(sx, sy) >= 0.08)"}[name]
    label = "null" if name == "obstacle" else "name"
    number = "row_number() over (partition by scan_id, name order by box_id)" if name == "object" else "1"
    tx, ty = {"floor": ("0.0", "-2.28"), "opening": ("case when up then cx + case when cx <= 0 then 0.24 else -0.24 end else cx end", "case when up then cy else cy + case when cy <= 0 then 0.22 else -0.22 end end")}.get(name, ("cx", "cy"))
    return f"select scan_id, '{name}' as layer, box_id as item_id, {label}::varchar as label, {number} as number, {tx} as text_x, {ty} as text_y, cx, cy, ({hx})::double as hx, ({hy})::double as hy, radians(({deg})::double) as turn from {source}"


@query(
    f"{_B}, l as ({' union all '.join(_layer(n) for n in _SIDE)}), k(corner, i, j) as (values (0, -1, -1), (1, -1, 1), (2, 1, 1), (3, 1, -1)) "
    f"select scan_id, layer, item_id, label, number, {q6('text_x')} as text_x, {q6('text_y')} as text_y, corner, {q6('cx + i * hx * cos(turn) - j * hy * sin(turn)')} as x, {q6('cy + i * hx * sin(turn) + j * hy * cos(turn)')} as y from l cross join k"
)
def plan_outlines(spark, sf_dir):
    """Corners of the floor, openings, objects and obstacles of every scan's plan."""
    b = _parts(spark, sf_dir)
    rooms = b.select("scan_id").distinct().select("scan_id", *(F.lit(v).alias(c) for c, v in (("lo_x", -2.0), ("hi_x", 2.0), ("lo_y", -2.0), ("hi_y", 2.0))))
    item = ["scan_id", F.col("box_id").alias("item_id"), F.col("name").alias("label"), "cx", "cy", "degrees"]
    objects = b.filter("part > 1").select(*item, F.col("sx").alias("length"), F.col("sy").alias("width"), F.when(F.col("part") == 9, F.col("box_id") - 1).alias("attached_to"))
    made = drawing.plan_outlines(rooms, b.filter("part = 0").select(*item, F.col("sx").alias("width")), objects, b.filter("part = 1").select(*item, "sx", "sy"))
    return made.withColumns({c: r6(c) for c in ("text_x", "text_y", "x", "y")})


@query(
    f"""{_B}, m as (select scan_id, case when scan_id % 5 <> 4 then round(avg(sx), 6) end as w, min_by(cx, box_id) as nx, min_by(cy, box_id) as ny, case when scan_id % 3 = 1 then 0.0 else round(avg(score) / 10, 6) end as t from b group by 1),
o as (select scan_id, name, min_by(cx, box_id) as cx, min_by(sx, box_id) as sx, min_by(part, box_id) as part from b group by 1, 2)
select scan_id, 0 as risk_id, 0 as item, 'segment' as kind, case when scan_id % 2 = 0 then 'red' else 'yellow' end as level, {q6("case when scan_id % 6 = 5 then 0 else nx end - w / 2")} as x1, {q6("case when scan_id % 6 = 5 then 0 else nx end + w / 2")} as x2, {q6("case when scan_id % 6 = 5 then 0.02 else 0.1 end")} as z2, null::double as extent, null::varchar as named from m where w is not null
union all select scan_id, 1, 0, 'arrow', case when scan_id % 4 = 2 then 'red' else 'yellow' end, 0.0, 0.0, {q6("t")}, null, null from m where t > 0 and scan_id % 4 <> 3
union all select b.scan_id, 2, b.part - 2, 'box', 'green', null, null, null, {q6("o.sx")}, o.name from b join o on b.scan_id = o.scan_id and b.name = o.name where b.box_id % 100 < 10 and b.part between 2 and 8 and b.part % 2 = 0 and o.part <> 5"""
)
def risk_shapes(spark, sf_dir):
    """Segments, arrows and boxes of every scan's risks."""
    b = _parts(spark, sf_dir)
    k = F.col("scan_id")
    narrow = F.when(k % 6 != 5, F.array(F.min_by("cx", "box_id"), F.min_by("cy", "box_id"), F.lit(0.1)))
    measures = b.groupBy("scan_id").agg(F.when(k % 5 != 4, F.round(F.avg("sx"), 6)).alias("passage_width"), narrow.alias("narrowest"), F.when(k % 3 == 1, 0.0).otherwise(F.round(F.avg("score") / 10, 6)).alias("threshold"))
    listed = F.array_sort(F.collect_list(F.when((F.col("box_id") % 100 < 10) & F.col("part").between(2, 8), F.struct("part", F.col("name").alias("label"), (F.col("part") % 2 == 0).alias("boxed")))))
    told = b.groupBy("scan_id").agg(F.transform(listed, lambda s: F.struct(s["label"].alias("label"), s["boxed"].alias("boxed"))).alias("obstacles"))
    level = [F.when(k % 2 == 0, "red").otherwise("yellow"), F.when(k % 4 == 3, "unknown").when(k % 4 == 2, "red").otherwise("yellow"), F.lit("green")]
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("risk_id"), F.lit(c).alias("code"), v.alias("level")) for i, (c, v) in enumerate(zip(("passage_width", "threshold", "obstacle"), level))))
    risks = told.select("scan_id", "obstacles", F.explode(rows).alias("r")).select("scan_id", "r.*", "obstacles")
    size = F.when(F.col("part") == 5, F.array().cast("array<double>")).otherwise(F.array("sx", "sy", "sz"))
    objects = b.select("scan_id", F.col("box_id").alias("object_id"), F.col("name").alias("label"), F.array("cx", "cy", "cz").alias("center"), F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))).alias("axes"), size.alias("extents"))
    made = drawing.risk_shapes(risks, measures, objects)
    return made.select("scan_id", "risk_id", "item", "kind", "level", r6(F.col("p1")[0]).alias("x1"), r6(F.col("p2")[0]).alias("x2"), r6(F.col("p2")[2]).alias("z2"), r6(F.col("extents")[0]).alias("extent"), F.when(F.col("kind") == "box", F.col("label")).alias("named"))


@query(
    f"""{_B}, g as (select l.scan_id, l.box_id as first_id, r.box_id as second_id, l.label = 3 or r.label = 3 as bed, greatest(abs(l.cx - r.cx) - (l.sx + r.sx) / 2, abs(l.cy - r.cy) - (l.sy + r.sy) / 2, 0) as gap from b l join b r on l.scan_id = r.scan_id and l.box_id // 10 = r.box_id // 10 and l.box_id < r.box_id),
p as (select *, row_number() over (partition by scan_id order by case when bed then 0 else 1 end, first_id, second_id) as place from g where gap > 1e-6) select scan_id, place, first_id, second_id, {q6("gap")} as gap from p where place <= 7"""
)
def listed_gaps(spark, sf_dir):
    """The seven gaps listed beside a plan, those at beds first; neighbours are the ten boxes of a group."""
    b = _parts(spark, sf_dir).withColumn("near", F.floor(F.col("box_id") / 10))
    side = lambda n: b.select("scan_id", "near", F.col("box_id").alias(f"{n}_id"), F.when(F.col("label") == 3, "bed").otherwise(F.col("name")).alias(f"{n}_label"), *(F.col(c).alias(f"{n}_{c}") for c in ("cx", "cy", "sx", "sy")))
    apart = lambda c: F.abs(F.col(f"first_c{c}") - F.col(f"second_c{c}")) - (F.col(f"first_s{c}") + F.col(f"second_s{c}")) / 2
    pairs = side("first").join(side("second"), ["scan_id", "near"]).filter("first_id < second_id").withColumn("gap", F.greatest(apart("x"), apart("y"), F.lit(0.0)))
    return drawing.listed_gaps(pairs).withColumn("gap", r6("gap"))
