"""Completion of floors and walls for display: points in the cells that nothing observed.

Observed cells and the cells of a surface meet in an anti join; openings are cut
out, and a new point takes the colour of the nearest observed one of its surface.
New points lie within their cell, off its middle by a hash, so a run repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.operators import spatial
from habitrace.session import settled

#: How near to a surface a point belongs to it, slack beside a wall and around an opening, how far from its cell's middle a new point lies, least points of a floor.
NEAR, BESIDE, MARGIN, SPREAD, LEAST_FLOOR = 0.075, 0.05, 0.08, 0.32, 100

SURFACE = ["scan_id", "surface"]


def _rows(low: Column, high: Column, cell: float) -> Column:
    """Numbers k of the cells whose middle low + (k + 1/2) cell lies below ``high``."""
    last = F.ceil((high - low) / cell - 0.5).cast("long") - 1
    return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))


def _cell(at: Column, low: Column, cell: float) -> Column:
    """The number of the cell, from ``low`` on, in which ``at`` lies."""
    return F.floor((at - low) / cell).cast("long")


def _filled(observed: DataFrame, middles: DataFrame, cell: float, seed: int) -> DataFrame:
    """``middles`` (SURFACE, ku, kv, u, v, ...) of cells that no ``observed`` (SURFACE, ku, kv) is in, moved a little inside them."""
    empty = middles.join(observed.select(*SURFACE, "ku", "kv").distinct(), [*SURFACE, "ku", "kv"], "left_anti")
    off = lambda c: (F.pmod(F.xxhash64(*SURFACE, "ku", "kv", F.lit(c), F.lit(seed)), F.lit(2**20)) / 2.0**19 - 1) * (SPREAD * cell)
    return empty.withColumns({f"n{c}": F.col(c) + off(c) for c in "uv"})


def _coloured(new: DataFrame, observed: DataFrame, reach: float) -> DataFrame:
    """``new`` (nu, nv) with the colour of the nearest observed point of its surface; none where a surface has none."""
    made = settled(new.withColumn("point_id", -1 - (F.col("ku") + 2**24) * 2**26 - (F.col("kv") + 2**24)))
    seen = settled(observed.select(*SURFACE, "point_id", "u", "v", "colour"))
    at = made.select(*SURFACE, "point_id", F.col("nu").alias("u"), F.col("nv").alias("v"))
    near = spatial.nearest(at, seen, 1, reach, keys=tuple(SURFACE), cols=("u", "v")).select(*SURFACE, F.col("a").alias("point_id"), "b")
    return made.join(near, [*SURFACE, "point_id"], "left").join(seen.select(*SURFACE, F.col("point_id").alias("b"), "colour"), [*SURFACE, "b"], "left")


def walls(points: DataFrame, sides: DataFrame, openings: DataFrame, cell: float = 0.015, seed: int = 45) -> DataFrame:
    """(scan_id, wall_id, x, y, z, window, colour): points for the empty cells of each wall.

    ``points`` (scan_id, point_id, x, y, z, colour), ``sides`` (scan_id,
    wall_id, wx, wy, yaw, length, height), ``openings`` (scan_id, wall_id,
    kind, along, bottom, width, height). No point is made in a door; one in a
    window is marked. Points with a null or non-finite coordinate observe
    nothing; a wall without points is filled whole, without colour.
    """
    w = settled(sides.select("scan_id", F.col("wall_id").alias("surface"), "wx", "wy", "yaw", "length", "height"))
    c, s = F.cos("yaw"), F.sin("yaw")
    dx, dy = F.col("x") - F.col("wx"), F.col("y") - F.col("wy")
    met = points.filter(spatial.finite("x", "y", "z")).join(w, "scan_id").withColumns({"u": c * dx + s * dy, "v": F.col("z").cast("double"), "away": F.abs(c * dy - s * dx)})
    own = settled(met.filter((F.col("away") <= NEAR) & (F.abs("u") <= F.col("length") / 2 + BESIDE) & F.col("v").between(F.lit(0.0), F.col("height"))).select(*SURFACE, "point_id", "u", "v", "colour", _cell(F.col("u"), -F.col("length") / 2, cell).alias("ku"), _cell(F.col("v"), F.lit(0.0), cell).alias("kv")))
    grid = w.withColumn("i", F.explode(_rows(-F.col("length") / 2, F.col("length") / 2, cell))).withColumn("j", F.explode(_rows(F.lit(0.0), F.col("height"), cell)))
    middles = grid.select(*SURFACE, F.col("i").alias("ku"), F.col("j").alias("kv"), (-F.col("length") / 2 + (F.col("i") + 0.5) * cell).alias("u"), ((F.col("j") + 0.5) * cell).alias("v"))
    empty = settled(_filled(own, middles, cell, seed))
    o = openings.select("scan_id", F.col("wall_id").alias("surface"), "kind", "along", "bottom", F.col("width").alias("w"), F.col("height").alias("h"))
    inside = (F.abs(F.col("u") - F.col("along")) <= F.col("w") / 2 + MARGIN) & F.col("v").between(F.col("bottom") - MARGIN, F.col("bottom") + F.col("h") + MARGIN)
    cut = empty.join(o, SURFACE).filter(inside).groupBy(*SURFACE, "ku", "kv").agg(F.max(F.col("kind") == "door").alias("door"), F.max(F.col("kind") == "window").alias("window"))
    kept = empty.join(cut, [*SURFACE, "ku", "kv"], "left").filter(~F.coalesce("door", F.lit(False)))
    done = _coloured(kept, own, 4 * cell).join(w, SURFACE)
    return done.select("scan_id", F.col("surface").alias("wall_id"), (F.col("wx") + c * F.col("nu")).alias("x"), (F.col("wy") + s * F.col("nu")).alias("y"), F.col("nv").alias("z"), F.coalesce("window", F.lit(False)).alias("window"), "colour")


def floors(points: DataFrame, rooms: DataFrame, cell: float = 0.015, least: int = LEAST_FLOOR, seed: int = 45) -> DataFrame:
    """(scan_id, x, y, z, colour): points for the empty cells of each room's floor, at height zero.

    ``rooms`` (scan_id, lo_x, hi_x, lo_y, hi_y). A floor on which fewer than
    ``least`` points lie (up to 0.075 high, or below) is not filled.
    """
    low = points.filter(spatial.finite("x", "y", "z") & (F.col("z") <= NEAR)).select("scan_id", F.lit(0).alias("surface"), "point_id", F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v"), "colour")
    enough = low.groupBy("scan_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("scan_id")
    own = low.join(enough, "scan_id", "left_semi").join(rooms, "scan_id").withColumns({"ku": _cell(F.col("u"), F.col("lo_x"), cell), "kv": _cell(F.col("v"), F.col("lo_y"), cell)})
    own = settled(own.select(*SURFACE, "point_id", "u", "v", "colour", "ku", "kv"))
    grid = rooms.join(enough, "scan_id", "left_semi").withColumn("i", F.explode(_rows(F.col("lo_x"), F.col("hi_x"), cell))).withColumn("j", F.explode(_rows(F.col("lo_y"), F.col("hi_y"), cell)))
    middles = grid.select("scan_id", F.lit(0).alias("surface"), F.col("i").alias("ku"), F.col("j").alias("kv"), (F.col("lo_x") + (F.col("i") + 0.5) * cell).alias("u"), (F.col("lo_y") + (F.col("j") + 0.5) * cell).alias("v"))
    done = _coloured(_filled(own, middles, cell, seed), own, 4 * cell)
    return done.select("scan_id", F.col("nu").alias("x"), F.col("nv").alias("y"), F.lit(0.0).alias("z"), "colour")
