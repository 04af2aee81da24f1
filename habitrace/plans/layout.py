"""Layout checks: clearances, overlaps, walls, openings, greedy suppression."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from habitrace.operators import layout as ops
from habitrace.plans.define import q6, query, r6
from habitrace.sources.driver_tables import ROOM_BOXES_SQL, room_boxes, table

_B = f"with {ROOM_BOXES_SQL}, {ops.FOOTPRINT_SQL}"
_GAP = "sqrt(pow(greatest(greatest(l.x0, r.x0) - least(l.x1, r.x1), 0), 2) + pow(greatest(greatest(l.y0, r.y0) - least(l.y1, r.y1), 0), 2))"
_AREA = "greatest(least(l.x1, r.x1) - greatest(l.x0, r.x0), 0) * greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0)"
_LR = "fp l join fp r on l.scan_id = r.scan_id and l.box_id < r.box_id"


def _pairs(spark, sf_dir, reach):
    return ops.near_pairs(ops.footprint(room_boxes(spark, sf_dir)), reach, 0.5)


@query(f"{_B}, p as (select l.scan_id, l.box_id as a, r.box_id as b, {_GAP} as gap from {_LR}) select scan_id, a, b, {q6('gap')} as gap from p where gap <= 0.3")
def pair_clearance(spark, sf_dir):
    found = _pairs(spark, sf_dir, 0.3).select(F.col("l.scan_id").alias("scan_id"), F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), ops.clearance().alias("gap"))
    return found.filter("gap <= 0.3").withColumn("gap", r6("gap"))


@query(f"{_B}, p as (select l.scan_id, l.box_id as a, r.box_id as b, {_AREA} as area from {_LR}) select scan_id, a, b, {q6('area')} as area from p where area > 0.004")
def layout_overlap(spark, sf_dir):
    found = _pairs(spark, sf_dir, 0.0).select(F.col("l.scan_id").alias("scan_id"), F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), ops.overlap_area().alias("area"))
    return found.filter("area > 0.004").withColumn("area", r6("area"))


@query(
    f"""{_B}, d as (select scan_id, box_id as door_id, cx - 0.3 as x0, cx + 0.3 as x1, cy as y0, cy + 0.6 as y1 from boxes where label = 0)
select d.door_id, r.box_id as object_id, {q6(_AREA.replace('l.', 'd.'))} as blocked from d join fp r on d.scan_id = r.scan_id and r.label <> 0 where {_AREA.replace('l.', 'd.')} > 0.02"""
)
def door_zone_block(spark, sf_dir):
    """Objects in the 0.6 m zone before a door; doors are few per scan, so the zone side is gridded too."""
    b = ops.footprint(room_boxes(spark, sf_dir))
    zone = b.filter("label = 0").select("scan_id", "box_id", F.lit(0).alias("label"), (F.col("cx") - 0.3).alias("x0"), (F.col("cx") + 0.3).alias("x1"), F.col("cy").alias("y0"), (F.col("cy") + 0.6).alias("y1"))
    objects = b.filter("label <> 0").select("scan_id", "box_id", "label", "x0", "x1", "y0", "y1")
    cells = lambda f: f.withColumn("gx", F.explode(F.sequence(F.floor(F.col("x0") / 0.5), F.floor(F.col("x1") / 0.5)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("y0") / 0.5), F.floor(F.col("y1") / 0.5))))
    l, r = cells(zone).alias("l"), cells(objects).alias("r")
    met = l.join(r, (F.col("l.scan_id") == F.col("r.scan_id")) & (F.col("l.gx") == F.col("r.gx")) & (F.col("l.gy") == F.col("r.gy")))
    found = met.select(F.col("l.box_id").alias("door_id"), F.col("r.box_id").alias("object_id"), ops.overlap_area().alias("area")).distinct()
    return found.filter("area > 0.02").select("door_id", "object_id", r6("area").alias("blocked"))


_I = "iv as (select l_partkey as wall_id, l_orderkey * 10 + l_linenumber as id, l_returnflag = 'R' as door, l_quantity as a, l_quantity + 2 + l_tax * 100 as b from lineitem)"


@query(
    f"""with {_I} select d.wall_id, d.id as door_id, w.id as window_id, {q6('(least(d.b, w.b) - greatest(d.a, w.a)) / least(d.b - d.a, w.b - w.a)')} as ratio
from iv d join iv w using (wall_id) where d.door and not w.door and least(d.b, w.b) - greatest(d.a, w.a) >= 0.25 * least(d.b - d.a, w.b - w.a)"""
)
def interval_overlap(spark, sf_dir):
    """Doors against windows on the same wall: an equi join on the wall with the interval predicate."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("wall_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").alias("door"), F.col("l_quantity").alias("a"), (F.col("l_quantity") + 2 + F.col("l_tax") * 100).alias("b"))
    d, w = l.filter("door").select("wall_id", F.col("id").alias("door_id"), F.col("a").alias("da"), F.col("b").alias("db")), l.filter("not door").select("wall_id", F.col("id").alias("window_id"), F.col("a").alias("wa"), F.col("b").alias("wb"))
    shared, short = F.least("db", "wb") - F.greatest("da", "wa"), F.least(F.col("db") - F.col("da"), F.col("wb") - F.col("wa"))
    return d.join(w, "wall_id").filter(shared >= 0.25 * short).select("wall_id", "door_id", "window_id", r6(shared / short).alias("ratio"))


#: The four walls of a room: (wall_id, axis, place, angle).
_WALLS = [(0, "y", -2.0, 0.0), (1, "x", 2.0, 90.0), (2, "y", 2.0, 0.0), (3, "x", -2.0, 90.0)]
_W = "w(wall_id, axis, place, angle) as (values " + ", ".join(f"({a}, '{b}', {c}, {d})" for a, b, c, d in _WALLS) + ")"
_TURN = "abs(((degrees(yaw) - angle + 90) % 180 + 180) % 180 - 90)"


@query(
    f"""{_B}, {_W}, s as (select box_id, wall_id, abs(case axis when 'x' then cx else cy end - place) + 0.02 * {_TURN} as cost from boxes cross join w),
k as (select *, row_number() over (partition by box_id order by cost, wall_id) as r from s) select box_id, wall_id, {q6('cost')} as cost from k where r = 1"""
)
def argmin_wall(spark, sf_dir):
    """The nearest of four walls by distance + 0.02 x turn; the walls are an array per box, so no join at all."""
    turn = lambda a: F.abs(F.pmod(F.degrees("yaw") - a + 90, F.lit(180.0)) - 90)
    costs = F.array(*(F.struct((F.abs(F.col("cx" if axis == "x" else "cy") - place) + 0.02 * turn(angle)).alias("cost"), F.lit(i).alias("wall_id")) for i, axis, place, angle in _WALLS))
    return room_boxes(spark, sf_dir).select("box_id", F.array_min(costs).alias("b")).select("box_id", "b.wall_id", r6("b.cost").alias("cost"))


@query(
    f"""{_B}, c as (select label, box_id, sx, sy, sz, cz - sz / 2 as bottom from boxes), k as (select *, row_number() over (partition by label order by greatest(sx, sy), box_id) as r from c where greatest(sx, sy) <= 0.38 and bottom <= 2)
select label, box_id, {q6('greatest(sx, sy)')} as extent from k where r = 1"""
)
def candidate_extent(spark, sf_dir):
    extent = F.greatest("sx", "sy")
    ok = room_boxes(spark, sf_dir).filter((extent <= 0.38) & (F.col("cz") - F.col("sz") / 2 <= 2))
    return ok.groupBy("label").agg(F.min(F.struct(extent.alias("extent"), "box_id")).alias("b")).select("label", "b.box_id", r6("b.extent").alias("extent"))


@query(
    f"""{_B}, n as (select scan_id, box_id, count(*) over (partition by scan_id, floor(cx / 1.0), floor(cy / 1.0)) as around, count(*) over (partition by scan_id, floor(cx / 1.0)) as strip from boxes)
select box_id, case when around >= 3 and strip >= 6 then 'strict' when around >= 3 then 'semantic_window' when strip >= 6 then 'semantic_door' else 'rejected' end as decision, {q6('around * 1.0 / strip')} as density from n"""
)
def opening_density(spark, sf_dir):
    around = F.count("*").over(Window.partitionBy("scan_id", F.floor("cx"), F.floor("cy")))
    strip = F.count("*").over(Window.partitionBy("scan_id", F.floor("cx")))
    n = room_boxes(spark, sf_dir).select("box_id", around.alias("around"), strip.alias("strip"))
    decision = F.when((F.col("around") >= 3) & (F.col("strip") >= 6), "strict").when(F.col("around") >= 3, "semantic_window").when(F.col("strip") >= 6, "semantic_door").otherwise("rejected")
    return n.select("box_id", decision.alias("decision"), r6(F.col("around") / F.col("strip")).alias("density"))


@query(f"{_B}, p as (select l.scan_id, l.box_id as a, r.box_id as b, {_GAP} as gap from {_LR}), k as (select *, row_number() over (order by round(gap, 9), a, b) as r from p where gap <= 0.5 and gap > 0) select a, b, {q6('gap')} as gap from k where r <= 24")
def smallest_24(spark, sf_dir):
    found = _pairs(spark, sf_dir, 0.5).select(F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), ops.clearance().alias("gap")).filter("gap <= 0.5 and gap > 0")
    return found.orderBy(F.round("gap", 9), "a", "b").limit(24).withColumn("gap", r6("gap"))


@query(f"{_B}, p as (select l.box_id as a, r.box_id as b, {_GAP} as gap from fp l join fp r on l.scan_id = r.scan_id and l.box_id <> r.box_id), k as (select *, row_number() over (partition by a order by round(gap, 9), b) as r from p where gap <= 0.5) select a, b, r::bigint as place from k where r <= 2")
def nearest_two(spark, sf_dir):
    """Up to two nearest other objects within half a metre."""
    half = _pairs(spark, sf_dir, 0.5).select(F.col("l.box_id").alias("a"), F.col("r.box_id").alias("b"), ops.clearance().alias("gap")).filter("gap <= 0.5")
    both = half.union(half.select("b", "a", "gap"))
    k = F.row_number().over(Window.partitionBy("a").orderBy(F.round("gap", 9), "b"))
    return both.withColumn("place", k.cast("bigint")).filter("place <= 2").select("a", "b", "place")


@query(f"{_B} select box_id, {q6('x1 - x0')} as dx, {q6('y1 - y0')} as dy, {q6(_TURN.replace('angle', '32'))} as turn, {q6('sx * sy * sz')} as volume from fp")
def footprints(spark, sf_dir):
    turn = F.abs(F.pmod(F.degrees("yaw") - 32 + 90, F.lit(180.0)) - 90)
    return ops.footprint(room_boxes(spark, sf_dir)).select("box_id", r6(F.col("x1") - F.col("x0")).alias("dx"), r6(F.col("y1") - F.col("y0")).alias("dy"), r6(turn).alias("turn"), r6(F.col("sx") * F.col("sy") * F.col("sz")).alias("volume"))


@query(
    f"""{_B}, o as (select l.label, l.box_id as keep, r.box_id as dropped, {_AREA} / least((l.x1 - l.x0) * (l.y1 - l.y0), (r.x1 - r.x0) * (r.y1 - r.y0)) as share from fp l join fp r on l.scan_id = r.scan_id and l.label = r.label and l.box_id <> r.box_id and (l.score > r.score or l.score = r.score and l.box_id < r.box_id))
select dropped as box_id, count(*) as rivals, {q6('max(share)')} as share from o where share > 0.6 group by 1"""
)
def overlap_rivals(spark, sf_dir):
    """For each box the better boxes of its label that cover it: the candidates of suppression."""
    f = _pairs(spark, sf_dir, 0.0).filter("l.label = r.label")
    size = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    left_wins = (F.col("l.score") > F.col("r.score")) | ((F.col("l.score") == F.col("r.score")) & (F.col("l.box_id") < F.col("r.box_id")))
    found = f.select(F.when(left_wins, F.col("r.box_id")).otherwise(F.col("l.box_id")).alias("box_id"), (ops.overlap_area() / F.least(size("l"), size("r"))).alias("share"))
    return found.filter("share > 0.6").groupBy("box_id").agg(F.count("*").alias("rivals"), r6(F.max("share")).alias("share"))


@query()
def nms_greedy(spark, sf_dir):
    """Greedy suppression of boxes of one label in one scan (view), best score first."""
    return ops.suppressed(room_boxes(spark, sf_dir), 0.5, 0.5).select("box_id", "kept")


@query()
def nms_across_labels(spark, sf_dir):
    """Suppression across the labels of containers (cabinet, wardrobe, shelf: 1 to 3) where boxes nearly coincide."""
    return ops.suppressed(room_boxes(spark, sf_dir).filter("label between 1 and 3"), 0.85, 0.5, same_label=False).select("box_id", "kept")


@query()
def duplicate_removal(spark, sf_dir):
    """Of objects that overlap by 60 % of the smaller footprint at about one height, the one with priority stays."""
    return ops.without_duplicates(room_boxes(spark, sf_dir), 0.5).select("box_id", "kept")


@query()
def near_duplicate_boxes(spark, sf_dir):
    """Boxes of one label that nearly coincide: the largest volume stays."""
    return ops.without_near_copies(room_boxes(spark, sf_dir)).select("box_id", "kept")


@query("select p_brand as class, count(*) as n, round(quantile_cont(p_size, 0.9), 6) + 0.0 as top_height, round(quantile_cont(p_size, 0.99) - quantile_cont(p_size, 0.01), 6) + 0.0 as range from part group by 1")
def class_dimensions(spark, sf_dir):
    q = F.percentile("p_size", F.array(F.lit(0.9), F.lit(0.99), F.lit(0.01)))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("class")).agg(F.count("*").alias("n"), r6(q[0]).alias("top_height"), r6(q[1] - q[2]).alias("range"))
