"""Floor grids of scans: free cells, clearances, openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitrace.operators import graph, spatial
from habitrace.session import settled

KEYS = ["scan_id", "row", "col"]


def cells(points: DataFrame, size: float, blocks: Column, border: int = 1) -> DataFrame:
    """(scan_id, row, col, blocked): the rectangle around each scan's points, ``border`` cells wider.

    A cell is blocked if a point with ``blocks`` lies in it.
    """
    placed = points.select("scan_id", spatial.cell("y", size).alias("row"), spatial.cell("x", size).alias("col"), blocks.alias("blocks"))
    taken = placed.filter("blocks").select(*KEYS).distinct().withColumn("blocked", F.lit(True))
    b = placed.groupBy("scan_id").agg(*(f(c).alias(f"{n}{c}") for c in ("row", "col") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    rows = b.select("scan_id", F.explode(F.sequence(F.col("lorow") - border, F.col("hirow") + border)).alias("row"), "locol", "hicol")
    grid = rows.select("scan_id", "row", F.explode(F.sequence(F.col("locol") - border, F.col("hicol") + border)).alias("col"))
    return grid.join(taken, KEYS, "left").select(*KEYS, F.coalesce("blocked", F.lit(False)).alias("blocked"))


def distance_transform(grid: DataFrame) -> DataFrame:
    """(scan_id, row, col, blocked, clearance): cells to the nearest blocked one, at any distance (Euclid, exact).

    First the nearest blocked cell in a cell's own column, then the best over
    the columns of its row; a scan without a blocked cell has none (null).
    """
    up = Window.partitionBy("scan_id", "col").orderBy("row")
    hit = F.when(F.col("blocked"), F.col("row"))
    before = F.last(hit, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(hit, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    in_column = settled(grid.select(*KEYS, "blocked", F.least(F.col("row") - before, after - F.col("row")).alias("g")))
    other = in_column.filter("g is not null").select("scan_id", "row", F.col("col").alias("at"), "g")
    d2 = F.min((F.col("col") - F.col("at")) * (F.col("col") - F.col("at")) + F.col("g") * F.col("g"))
    best = in_column.select(*KEYS).join(other.withColumnRenamed("g", "g"), ["scan_id", "row"]).groupBy(*KEYS).agg(d2.alias("d2"))
    return in_column.join(best, KEYS, "left").select(*KEYS, "blocked", F.sqrt("d2").alias("clearance"))


def nearest_free(free: DataFrame, seeds: DataFrame, reach: int | None = None) -> DataFrame:
    """(scan_id, row, col): the free cell nearest to each seed (scan_id, srow, scol): least (square ring, Euclid, row, col).

    ``reach`` bounds the ring, as the reference's 15 or 30; without it any distance will do.
    """
    dr, dc = F.abs(F.col("row") - F.col("srow")), F.abs(F.col("col") - F.col("scol"))
    met = free.select(*KEYS).join(seeds, "scan_id").withColumns({"ring": F.greatest(dr, dc), "d2": dr * dr + dc * dc})
    met = met if reach is None else met.filter(F.col("ring") <= reach)
    return met.groupBy("scan_id").agg(F.min(F.struct("ring", "d2", "row", "col")).alias("s")).select("scan_id", "s.row", "s.col")


def route_costs(grid: DataFrame, seeds: DataFrame, size: float, penalty: float = 0.035) -> DataFrame:
    """(scan_id, row, col, dist): cheapest ways over free cells, where steps near obstacles cost more.

    A step of length l into a cell costs l + penalty * l / max(clearance, size), in metres.
    """
    free = distance_transform(grid).filter("not blocked")
    near = F.greatest(F.coalesce(F.col("clearance") * size, F.lit(float("inf"))), F.lit(size))
    return graph.grid_distances(free.withColumn("cost", size * (1 + penalty / near)), seeds, graph.EIGHT, "cost")


def shortest_path(out: DataFrame, back: DataFrame, goals: DataFrame, steps: list[tuple[int, int, float]]) -> DataFrame:
    """(scan_id, row, col, dist): cells on a shortest way: both distances add up to the whole."""
    whole = out.join(goals, KEYS).groupBy("scan_id").agg(F.min("dist").alias("whole"))
    both = out.join(back.withColumnRenamed("dist", "rest"), KEYS).join(whole, "scan_id")
    return both.filter(F.abs(F.col("dist") + F.col("rest") - F.col("whole")) < 1e-9).select(*KEYS, "dist")


#: A full block of four cells, by its upper left one.
_BLOCK = [(0, 0), (0, 1), (1, 0), (1, 1)]


def _shifted(cells: DataFrame, steps: list[tuple[int, int]], sign: int = 1) -> DataFrame:
    spread = F.explode(F.array(*(F.struct(F.lit(sign * r).alias("r"), F.lit(sign * c).alias("c")) for r, c in steps)))
    return cells.select(*KEYS, spread.alias("s")).select("scan_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))


def opened(cells: DataFrame) -> DataFrame:
    """(scan_id, row, col): binary opening with a 2 x 2 square: the cells of blocks of four that are all taken."""
    full = _shifted(cells.select(*KEYS).distinct(), _BLOCK, -1).groupBy(*KEYS).agg(F.count("*").alias("n")).filter("n = 4")
    return _shifted(full, _BLOCK).distinct()


def obstacle_cells(points: DataFrame, size: float, least: int = 20, height: float = 0.12) -> DataFrame:
    """(scan_id, row, col, n, low, high): opened cells with ``least`` points whose 85 % height is ``height`` or more."""
    q = F.percentile("z", F.array(F.lit(0.05), F.lit(0.85)))
    held = points.groupBy("scan_id", spatial.cell("y", size).alias("row"), spatial.cell("x", size).alias("col")).agg(F.count("*").alias("n"), q.alias("q"))
    taken = settled(held.filter((F.col("n") >= least) & (F.col("q")[1] >= height)).select(*KEYS, "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))
    return taken.join(opened(taken), KEYS)


def obstacles(cells: DataFrame, least: int = 18) -> DataFrame:
    """(scan_id, component, cells, row0, row1, col0, col1, low, high): cells joined over eight neighbours, ``least`` or more.

    ``low`` is the 20 % quantile of the cells' low heights, ``high`` the 90 %
    quantile of their high ones; ``component`` is the first cell (row, then
    column) as row * 2^32 + column.
    """
    node = F.col("row") * 2**32 + F.col("col")
    named = settled(cells.select(*KEYS, "low", "high", node.alias("node")))
    # each pair once: the cells after in reading order
    told = named.select("scan_id", F.col("node").alias("a"), F.explode(F.array(*(F.lit(r * 2**32 + c) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("s")).select("scan_id", "a", (F.col("a") + F.col("s")).alias("b"))
    edges = told.join(named.select("scan_id", F.col("node").alias("b")), ["scan_id", "b"], "left_semi").select(F.col("scan_id").alias("scope"), "a", "b")
    found = graph.components(named.select(F.col("scan_id").alias("scope"), "node"), edges).withColumnRenamed("scope", "scan_id")
    j = named.join(found, ["scan_id", "node"]).groupBy("scan_id", "component")
    sizes = j.agg(F.count("*").alias("cells"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"), F.percentile("low", 0.2).alias("low"), F.percentile("high", 0.9).alias("high"))
    return sizes.filter(F.col("cells") >= least)
