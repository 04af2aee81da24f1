"""Long low things along the walls of a room, taken out of its points before they are clustered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Nearest and farthest distance from the wall, greatest height, slack above it, least length, least span and greatest start of height, cell along the wall, least points at a wall, least points and share that must stay.
NEAR, FAR, TOP, SLACK, LENGTH, SPAN, START, CELL, LEAST, STAY, SHARE = 0.03, 0.38, 0.55, 0.05, 1.0, 0.12, 0.25, 0.08, 60, 20, 0.25


def without_wall_strips(points: DataFrame, rooms: DataFrame, far: float = FAR, top: float = TOP, length: float = LENGTH, span: float = SPAN, start: float = START, cell: float = CELL, least: int = LEAST, stay: int = STAY) -> DataFrame:
    """``points`` without those of low strips along the four walls.

    ``points`` (scan_id, point_id, x, y, z, ...), ``rooms`` (scan_id, lo_x,
    hi_x, lo_y, hi_y). At a wall count points 0.03 to ``far`` from it and up to
    ``top`` high, if there are ``least``. A cell along the wall is low if no
    point of the room in that cell is clearly higher, its points span ``span``
    of height and begin at ``start`` or lower; a run of low cells of ``length``
    is a strip. A scan of which fewer than ``stay`` points or a quarter would
    stay keeps all, as do scans without a room. Points with a null place stay
    and count for nothing at a wall; repeated ones share their fate; other
    columns stay.
    """
    sides = F.array(*(F.struct(F.lit(w).alias("wall"), d.alias("depth"), F.floor(F.col(a) / cell).alias("bin")) for w, d, a in (
        (0, F.col("x") - F.col("lo_x"), "y"), (1, F.col("hi_x") - F.col("x"), "y"), (2, F.col("y") - F.col("lo_y"), "x"), (3, F.col("hi_y") - F.col("y"), "x"),
    )))
    at = points.dropna(subset=list("xyz")).join(rooms.select("scan_id", "lo_x", "hi_x", "lo_y", "hi_y"), "scan_id").select("scan_id", "point_id", "z", F.explode(sides).alias("s")).select("scan_id", "point_id", "z", "s.*")
    band = F.col("depth").between(NEAR, far) & (F.col("z") <= top)
    cells = at.groupBy("scan_id", "wall", "bin").agg(F.max("z").alias("highest"), F.count_if(band).alias("n"), F.min(F.when(band, F.col("z"))).alias("z0"), F.max(F.when(band, F.col("z"))).alias("z1"))
    crowded = cells.withColumn("all", F.sum("n").over(Window.partitionBy("scan_id", "wall"))).filter((F.col("all") >= least) & (F.col("n") > 0))
    low = crowded.filter((F.col("highest") <= top + SLACK) & (F.col("z1") - F.col("z0") >= span) & (F.col("z0") <= start))
    runs = low.withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy("scan_id", "wall").orderBy("bin")))
    long = runs.withColumn("cells", F.count("*").over(Window.partitionBy("scan_id", "wall", "run"))).filter(F.col("cells") * cell >= length)
    gone = at.filter(band).join(long.select("scan_id", "wall", "bin"), ["scan_id", "wall", "bin"]).select("scan_id", "point_id").distinct()
    marked = points.join(gone.withColumn("_strip", F.lit(True)), ["scan_id", "point_id"], "left")
    counts = marked.groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if(F.col("_strip").isNull()).alias("left"))
    kept_all = counts.filter(F.col("left") < F.greatest(F.lit(stay), F.floor(F.col("n") * SHARE))).select("scan_id", F.lit(True).alias("_all"))
    return marked.join(kept_all, "scan_id", "left").filter("_strip is null or _all").select(*points.columns)
