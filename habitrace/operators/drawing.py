"""What plans and reports draw, as rows: shapes of risks, outlines of a plan, the gaps that are listed beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half thickness of an opening's mark, distance of its text along x and y, width where none is known, side of an object where none is known, least side of an obstacle, gaps listed.
MARK, BESIDE_X, BESIDE_Y, OPENING_WIDTH, OBJECT_SIDE, LEAST_SIDE, LISTED = 0.09, 0.24, 0.22, 0.8, 0.2, 0.08, 7
#: Fixed place of a segment when the narrowest point is unknown.
UNPLACED = (0.0, 0.0, 0.02)
#: Texts beside the shapes; the caller may give others, each with one number of two decimals.
TEXTS = {"passage_width": "clear width %.2f m", "threshold": "threshold %.2f m", "obstacle": "obstacle"}
#: Corners of a rectangle in drawing order.
CORNERS = ((-1, -1), (-1, 1), (1, 1), (1, -1))
_SHAPE = "struct<item int, kind string, label string, p1 array<double>, p2 array<double>, center array<double>, axes array<double>, extents array<double>>"


def risk_shapes(risks: DataFrame, measures: DataFrame, objects: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(scan_id, risk_id, item, kind, label, level, p1, p2, center, axes, extents): a row per shape.

    ``risks`` (scan_id, risk_id, code, level, obstacles: array of (label,
    boxed)), ``measures`` (scan_id, passage_width, narrowest: three numbers,
    threshold; one row a scan), ``objects`` (scan_id, object_id, label, center,
    axes, extents). A red or yellow passage_width is a segment as long as the
    width, along x through the narrowest point; a red or yellow threshold above
    0 an arrow upwards from the origin; a boxed obstacle the box of the scan's
    object of that label, if that has all three (of several the lowest
    object_id). All other risks, and what was not measured, have no shape.
    """
    said = TEXTS | (texts or {})
    number = lambda *c: F.array(*(F.coalesce(v, F.lit(0.0)) for v in c)).cast("array<double>")
    none = F.lit(None).cast("array<double>")
    alarming = F.col("level").isin("red", "yellow")
    m = measures.select("scan_id", "passage_width", "narrowest", "threshold")
    at = [F.coalesce(F.get("narrowest", F.lit(k)), F.lit(v)) for k, v in enumerate(UNPLACED)]
    half = F.col("passage_width") / 2
    shape = lambda kind, label, p1, p2: F.struct(F.lit(0).alias("item"), F.lit(kind).alias("kind"), label.alias("label"), p1.alias("p1"), p2.alias("p2"), none.alias("center"), none.alias("axes"), none.alias("extents")).cast(_SHAPE)
    line = F.when((F.col("code") == "passage_width") & alarming & F.col("passage_width").isNotNull(), shape("segment", F.format_string(said["passage_width"], "passage_width"), number(at[0] - half, *at[1:]), number(at[0] + half, *at[1:])))
    line = line.when((F.col("code") == "threshold") & alarming & (F.col("threshold") > 0), shape("arrow", F.format_string(said["threshold"], "threshold"), number(*[F.lit(0.0)] * 3), number(F.lit(0.0), F.lit(0.0), F.col("threshold"))))
    lines = risks.filter(F.col("code").isin("passage_width", "threshold")).join(m, "scan_id").select("scan_id", "risk_id", "level", line.alias("s")).filter("s is not null")

    named = F.coalesce(F.col("o.label"), F.lit(said["obstacle"])).alias("label")
    listed = risks.filter("code = 'obstacle'").select("scan_id", "risk_id", "level", F.posexplode("obstacles").alias("item", "o")).filter("o.boxed").select("scan_id", "risk_id", "level", "item", named)
    full = F.lit(True)
    for c in ("center", "axes", "extents"):
        full = full & (F.size(F.coalesce(F.col(c), F.array())) > 0)
    own = objects.groupBy("scan_id", "label").agg(F.min_by(F.struct("center", "axes", "extents"), "object_id").alias("b")).select("scan_id", "label", "b.*").filter(full)
    boxes = listed.join(own, ["scan_id", "label"]).select("scan_id", "risk_id", "level", F.struct("item", F.lit("box").alias("kind"), "label", none.alias("p1"), none.alias("p2"), "center", "axes", "extents").cast(_SHAPE).alias("s"))
    return lines.union(boxes).select("scan_id", "risk_id", "s.item", "s.kind", "s.label", "level", "s.p1", "s.p2", "s.center", "s.axes", "s.extents")


def _outline(half_x: Column, half_y: Column, degrees: Column) -> Column:
    """The four corners of a turned rectangle around (cx, cy), numbered."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.array(*(F.struct(F.lit(k).alias("corner"), (F.col("cx") + i * half_x * cos - j * half_y * sin).alias("x"), (F.col("cy") + i * half_x * sin + j * half_y * cos).alias("y")) for k, (i, j) in enumerate(CORNERS)))


def plan_outlines(rooms: DataFrame, openings: DataFrame, objects: DataFrame, obstacles: DataFrame) -> DataFrame:
    """(scan_id, layer, item_id, label, number, text_x, text_y, corner, x, y): the outlines of a plan, a row per corner.

    ``rooms`` (scan_id, lo_x, hi_x, lo_y, hi_y), ``openings`` (scan_id,
    item_id, label, cx, cy, width, degrees), ``objects`` (scan_id, item_id,
    label, cx, cy, length, width, degrees, attached_to), ``obstacles`` (scan_id,
    item_id, cx, cy, sx, sy, degrees). An opening is a bar along x, or along y
    if its whole degrees are 90 (modulo 180), its text lies towards the room's
    middle. Objects attached to another are not drawn; drawn ones of one
    label are numbered from 1 by item_id. Obstacles lie lengthways and are left
    out below 0.08 of width. Widths that are null or 0 have their defaults, a null
    place is the room's middle, null degrees are 0. Only scans with a room are drawn.
    """
    middle = rooms.select("scan_id", ((F.col("lo_x") + F.col("hi_x")) / 2).alias("mx"), ((F.col("lo_y") + F.col("hi_y")) / 2).alias("my"))
    known = lambda c, default: F.when(F.col(c) != 0, F.col(c)).otherwise(F.lit(default))
    inside = lambda rows: rows.join(middle, "scan_id").withColumns({"cx": F.coalesce("cx", "mx"), "cy": F.coalesce("cy", "my"), "degrees": F.coalesce("degrees", F.lit(0.0))})
    names = ["scan_id", "layer", "item_id", "label", "number", "text_x", "text_y", "shape"]
    one = F.lit(1).cast("long").alias("number")

    wide = known("width", OPENING_WIDTH) / 2
    across = F.pmod(F.bround("degrees"), F.lit(180.0)) == 90
    text_x = F.when(across, F.col("cx") + F.when(F.col("cx") <= F.col("mx"), BESIDE_X).otherwise(-BESIDE_X)).otherwise(F.col("cx"))
    text_y = F.when(across, F.col("cy")).otherwise(F.col("cy") + F.when(F.col("cy") <= F.col("my"), BESIDE_Y).otherwise(-BESIDE_Y))
    bars = inside(openings).select("scan_id", F.lit("opening").alias("layer"), "item_id", "label", one, text_x.alias("text_x"), text_y.alias("text_y"), _outline(F.when(across, MARK).otherwise(wide), F.when(across, wide).otherwise(MARK), F.lit(0.0)).alias("shape"))

    order = Window.partitionBy("scan_id", "label").orderBy("item_id")
    drawn = inside(objects.filter("attached_to is null")).withColumn("number", F.row_number().over(order).cast("long"))
    things = drawn.select("scan_id", F.lit("object").alias("layer"), "item_id", "label", "number", F.col("cx").alias("text_x"), F.col("cy").alias("text_y"), _outline(known("length", OBJECT_SIDE) / 2, known("width", OBJECT_SIDE) / 2, F.col("degrees")).alias("shape"))

    long, short = F.greatest("sx", "sy"), F.least("sx", "sy")
    lumps = inside(obstacles.filter(short >= LEAST_SIDE)).select("scan_id", F.lit("obstacle").alias("layer"), "item_id", F.lit(None).cast("string").alias("label"), one, F.col("cx").alias("text_x"), F.col("cy").alias("text_y"), _outline(long / 2, short / 2, F.col("degrees")).alias("shape"))

    at = rooms.withColumns({"cx": (F.col("lo_x") + F.col("hi_x")) / 2, "cy": (F.col("lo_y") + F.col("hi_y")) / 2})
    floors = at.select("scan_id", F.lit("floor").alias("layer"), F.lit(0).cast("long").alias("item_id"), F.lit(None).cast("string").alias("label"), one, F.col("cx").alias("text_x"), (F.col("lo_y") - 0.28).alias("text_y"), _outline((F.col("hi_x") - F.col("lo_x")) / 2, (F.col("hi_y") - F.col("lo_y")) / 2, F.lit(0.0)).alias("shape"))
    every = floors.select(*names).union(bars.select(*names)).union(things.select(*names)).union(lumps.select(*names))
    return every.select(*names[:-1], F.explode("shape").alias("c")).select(*names[:-1], "c.*")


def listed_gaps(gaps: DataFrame, first: str = "bed", most: int = LISTED) -> DataFrame:
    """(scan_id, place, first_id, second_id, gap): the gaps that are listed beside a scan's plan, ``most`` of them.

    ``gaps`` (scan_id, first_id, second_id, first_label, second_label, gap).
    Gaps of things that touch (to 0.000001) or were not measured are left out;
    those of a thing labelled ``first`` come before the others, both by ids.
    """
    order = Window.partitionBy("scan_id").orderBy(F.when((F.col("first_label") == first) | (F.col("second_label") == first), 0).otherwise(1), "first_id", "second_id")
    placed = gaps.filter(F.col("gap") > 1e-6).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)
    return placed.select("scan_id", "place", "first_id", "second_id", "gap")
