"""Boxes on the floor: footprints, overlaps, clearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.operators import graph


def footprint(boxes: DataFrame) -> DataFrame:
    """Adds the axis-aligned footprint (x0, x1, y0, y1) of each turned box."""
    c, s = F.abs(F.cos("yaw")), F.abs(F.sin("yaw"))
    hx, hy = (c * F.col("sx") + s * F.col("sy")) / 2, (s * F.col("sx") + c * F.col("sy")) / 2
    return boxes.withColumns({"x0": F.col("cx") - hx, "x1": F.col("cx") + hx, "y0": F.col("cy") - hy, "y1": F.col("cy") + hy})


FOOTPRINT_SQL = """fp as (select *, cx - (abs(cos(yaw)) * sx + abs(sin(yaw)) * sy) / 2 as x0, cx + (abs(cos(yaw)) * sx + abs(sin(yaw)) * sy) / 2 as x1,
 cy - (abs(sin(yaw)) * sx + abs(cos(yaw)) * sy) / 2 as y0, cy + (abs(sin(yaw)) * sx + abs(cos(yaw)) * sy) / 2 as y1 from boxes)"""


def near_pairs(boxes: DataFrame, reach: float, grid: float) -> DataFrame:
    """Pairs (l, r; l.box_id < r.box_id) of a scan whose footprints come within ``reach`` per axis.

    Boxes are written to all cells that the widened footprint touches; a pair
    that shares several cells is kept in the one of its overlap's low corner.
    """
    low, high = (lambda c: F.floor((F.col(c) - reach / 2) / grid)), (lambda c: F.floor((F.col(c) + reach / 2) / grid))
    placed = boxes.withColumn("gx", F.explode(F.sequence(low("x0"), high("x1")))).withColumn("gy", F.explode(F.sequence(low("y0"), high("y1"))))
    l, r = placed.alias("l"), placed.alias("r")
    met = l.join(r, (F.col("l.scan_id") == F.col("r.scan_id")) & (F.col("l.gx") == F.col("r.gx")) & (F.col("l.gy") == F.col("r.gy")) & (F.col("l.box_id") < F.col("r.box_id")))
    corner = lambda c: F.floor((F.greatest(f"l.{c}", f"r.{c}") - reach / 2) / grid)
    gap = lambda a, b: F.greatest(F.col(f"l.{a}"), F.col(f"r.{a}")) - F.least(F.col(f"l.{b}"), F.col(f"r.{b}"))
    return met.filter((F.col("l.gx") == corner("x0")) & (F.col("l.gy") == corner("y0")) & (gap("x0", "x1") <= reach) & (gap("y0", "y1") <= reach))


def overlap_area() -> Column:
    side = lambda a, b: F.greatest(F.least(f"l.{b}", f"r.{b}") - F.greatest(f"l.{a}", f"r.{a}"), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def clearance() -> Column:
    side = lambda a, b: F.greatest(F.greatest(f"l.{a}", f"r.{a}") - F.least(f"l.{b}", f"r.{b}"), F.lit(0.0))
    return F.hypot(side("x0", "x1"), side("y0", "y1"))


def _size(side: str) -> Column:
    return (F.col(f"{side}.x1") - F.col(f"{side}.x0")) * (F.col(f"{side}.y1") - F.col(f"{side}.y0"))


def _first_wins(pairs: DataFrame, left_first: Column) -> DataFrame:
    """(better, worse) of pairs (l, r) by whether l comes first."""
    l, r = F.col("l.box_id"), F.col("r.box_id")
    return pairs.select(F.when(left_first, l).otherwise(r).alias("better"), F.when(left_first, r).otherwise(l).alias("worse"))


def _kept(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    chosen = graph.greedy_keep(boxes.select(F.col("box_id").alias("node")), edges)
    return boxes.join(chosen.withColumnRenamed("node", "box_id"), "box_id")


def suppressed(boxes: DataFrame, overlap: float, grid: float, same_label: bool = True) -> DataFrame:
    """``boxes`` with ``kept``: greedy suppression in each scan (view), best score first, then least id.

    A box goes if one that stays and comes first covers it with an IoU above
    ``overlap``; by label, or across all labels given.
    """
    hit = near_pairs(footprint(boxes), 0.0, grid)
    hit = hit.filter("l.label = r.label") if same_label else hit
    area = overlap_area()
    first = (F.col("l.score") > F.col("r.score")) | ((F.col("l.score") == F.col("r.score")) & (F.col("l.box_id") < F.col("r.box_id")))
    return _kept(boxes, _first_wins(hit.filter(area / (_size("l") + _size("r") - area) > overlap), first))


def without_duplicates(boxes: DataFrame, grid: float, overlap: float = 0.60, height: float = 0.55) -> DataFrame:
    """``boxes`` with ``kept``: greedy removal by priority (label, then score, then id) of what overlaps a box that stays.

    The overlap is the shared area over the smaller footprint; centres must be within ``height``.
    """
    hit = near_pairs(footprint(boxes), 0.0, grid)
    close = (overlap_area() / F.least(_size("l"), _size("r")) > overlap) & (F.abs(F.col("l.cz") - F.col("r.cz")) < height)
    order = lambda s: F.struct(F.col(f"{s}.label"), -F.col(f"{s}.score"), F.col(f"{s}.box_id"))
    return _kept(boxes, _first_wins(hit.filter(close), order("l") < order("r")))


def without_near_copies(boxes: DataFrame, least: float = 0.15) -> DataFrame:
    """``boxes`` with ``kept``: of boxes of one label whose centres nearly coincide, the largest volume stays.

    Near means less than ``least`` or half the lesser first side, whichever is more.
    """
    reach = boxes.agg(F.greatest(F.lit(least), F.max("sx") / 2)).first()[0] or least
    cell = [F.floor(F.col(c) / reach).alias(f"g{c}") for c in ("cx", "cy", "cz")]
    l = boxes.select("*", *cell)
    for c in ("gcx", "gcy", "gcz"):
        l = l.withColumn(c, F.explode(F.array(*(F.col(c) + k for k in (-1, 0, 1)))))
    l, r = l.alias("l"), boxes.select("*", *cell).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("scan_id", "label", "gcx", "gcy", "gcz")]
    met = l.join(r, same + [F.col("l.box_id") < F.col("r.box_id")])
    away = F.sqrt(sum(((F.col(f"l.{c}") - F.col(f"r.{c}")) ** 2 for c in ("cy", "cz")), (F.col("l.cx") - F.col("r.cx")) ** 2))
    near = met.filter(away < F.greatest(F.lit(least), F.least("l.sx", "r.sx") / 2))
    volume = lambda s: F.col(f"{s}.sx") * F.col(f"{s}.sy") * F.col(f"{s}.sz")
    first = (volume("l") > volume("r")) | ((volume("l") == volume("r")) & (F.col("l.box_id") < F.col("r.box_id")))
    return _kept(boxes, _first_wins(near, first))
