"""Spatial operators over keyed points: boxes, voxels, cells, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitrace.session import settled


def finite(*cols: str) -> Column:
    """Every coordinate is a finite number."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in cols))


def height_band(z: str, low: float = 0.10, high: float = 1.80) -> Column:
    """Heights within the band, both ends included."""
    return F.col(z).between(low, high)


def in_obb(x: Column, y: Column, z: Column, box: dict[str, Column], mx: float, my: float, mz: float) -> Column:
    """Point in a box turned about z by ``yaw`` (radians), with margins."""
    dx, dy = x - box["cx"], y - box["cy"]
    c, s = F.cos(box["yaw"]), F.sin(box["yaw"])
    return (F.abs(c * dx + s * dy) <= box["sx"] / 2 + mx) & (F.abs(c * dy - s * dx) <= box["sy"] / 2 + my) & (F.abs(z - box["cz"]) <= box["sz"] / 2 + mz)


def in_obb_sql(p: str, b: str, mx: float, my: float, mz: float) -> str:
    dx, dy = f"({p}.x - {b}.cx)", f"({p}.y - {b}.cy)"
    return f"(abs(cos({b}.yaw) * {dx} + sin({b}.yaw) * {dy}) <= {b}.sx / 2 + {mx} and abs(cos({b}.yaw) * {dy} - sin({b}.yaw) * {dx}) <= {b}.sy / 2 + {my} and abs({p}.z - {b}.cz) <= {b}.sz / 2 + {mz})"


def cell(col: str | Column, size: float) -> Column:
    return F.floor((F.col(col) if isinstance(col, str) else col) / size).cast("bigint")


def points_in_boxes(points: DataFrame, boxes: DataFrame, margins: tuple[float, float, float], grid: float) -> DataFrame:
    """(scan_id, point_id, box_id): containment through an equi join on xy cells.

    A box is written to the cells that its footprint's bounding square can
    touch, a point to its own cell; the turned box is tested exactly then.
    """
    reach = F.sqrt((F.col("sx") / 2 + margins[0]) ** 2 + (F.col("sy") / 2 + margins[1]) ** 2)
    span = lambda c: F.sequence(cell(F.col(c) - reach, grid), cell(F.col(c) + reach, grid))
    placed = boxes.withColumn("gx", F.explode(span("cx"))).withColumn("gy", F.explode(span("cy")))
    p = points.withColumn("gx", cell("x", grid)).withColumn("gy", cell("y", grid)).alias("p")
    b = placed.alias("b")
    box = {k: F.col(f"b.{k}") for k in ("cx", "cy", "cz", "sx", "sy", "sz", "yaw")}
    met = p.join(b, (F.col("p.scan_id") == F.col("b.scan_id")) & (F.col("p.gx") == F.col("b.gx")) & (F.col("p.gy") == F.col("b.gy")))
    inside = met.filter(in_obb(F.col("p.x"), F.col("p.y"), F.col("p.z"), box, *margins))
    return inside.select(F.col("p.scan_id").alias("scan_id"), F.col("p.point_id").alias("point_id"), F.col("b.box_id").alias("box_id"))


def radius_pairs(points: DataFrame, radius: float, cols: tuple[str, ...] = ("x", "y", "z"), keep: tuple[str, ...] = (), others: DataFrame | None = None) -> DataFrame:
    """(scan_id, a, b, d) for all ordered pairs within ``radius``: the cells around, then the exact distance.

    With ``others`` (the same columns), a is one of these and b one of ``points``.
    """
    cells = [cell(c, radius).alias(f"g{c}") for c in cols]
    left = (points if others is None else others).select("scan_id", F.col("point_id").alias("a"), *(F.col(c).alias(f"a{c}") for c in cols), *cells, *keep)
    for c in cols:
        left = left.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + k for k in (-1, 0, 1)))))
    right = points.select("scan_id", F.col("point_id").alias("b"), *(F.col(c).alias(f"b{c}") for c in cols), *cells)
    d2 = reduce(lambda p, q: p + q, ((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in cols))
    met = left.join(right, ["scan_id", *(f"g{c}" for c in cols)]).filter("a <> b").withColumn("d", F.sqrt(d2))
    return met.filter(F.col("d") <= radius).select("scan_id", "a", "b", "d", *keep)


def with_neighbours(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(scan_id, point_id, kept): whether a point has ``least`` others within ``radius``, exactly.

    Cells of side radius / 1.75 have diagonals under ``radius``: more than
    ``least`` points in one of them all have their neighbours there. Only the
    points of emptier cells are measured, against all points around.
    """
    p = settled(points.select("scan_id", "point_id", *"xyz", *(cell(c, radius / 1.75).alias(f"s{c}") for c in "xyz")))
    small = ["scan_id", "sx", "sy", "sz"]
    full = p.filter(finite(*"xyz")).groupBy(*small).agg(F.count_distinct("point_id").alias("n")).filter(F.col("n") > least).select(*small)
    crowded = p.join(full, small, "left_semi").select("scan_id", "point_id")
    rest = settled(p.join(full, small, "left_anti").select("scan_id", "point_id", *"xyz"))
    n = radius_pairs(p, radius, others=rest).groupBy("scan_id", F.col("a").alias("point_id")).agg(F.count("*").alias("n"))
    told = rest.join(n, ["scan_id", "point_id"], "left").select("scan_id", "point_id", (F.coalesce("n", F.lit(0)) >= least).alias("kept"))
    return crowded.withColumn("kept", F.lit(True)).union(told)


def nearest(points: DataFrame, others: DataFrame, k: int, reach: float, keys: tuple[str, ...] = ("scan_id",), cols: tuple[str, ...] = ("x", "y", "z"), most: float = float("inf")) -> DataFrame:
    """(keys, a, b, d, rank): the ``k`` nearest of ``others`` to each of ``points``, at any distance up to ``most``.

    A growing ring: all within ``reach`` are met by cells; points that have
    fewer than ``k`` there try again with twice the reach, until none is left
    or the reach spans the whole cloud. ``points`` and ``others`` have
    ``point_id`` and the keys; a point is not its own neighbour.
    """
    far = others.agg(*(F.max(c) - F.min(c) for c in cols)).first()
    span = sum(float(x or 0) ** 2 for x in far) ** 0.5
    wide = points.agg(*(f(c) for c in cols for f in (F.min, F.max)), F.count("*")).first()
    span += sum(max(abs(float(x or 0)) for x in wide[2 * i : 2 * i + 2]) for i in range(len(cols))) * 2
    todo, found, reach = settled(points), None, min(reach, most)
    order = Window.partitionBy(*keys, "a").orderBy("d", "b")
    while True:
        cells = [cell(c, reach).alias(f"g{c}") for c in cols]
        left = todo.select(*keys, F.col("point_id").alias("a"), *(F.col(c).alias(f"a{c}") for c in cols), *cells)
        for c in cols:
            left = left.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + j for j in (-1, 0, 1)))))
        right = others.select(*keys, F.col("point_id").alias("b"), *(F.col(c).alias(f"b{c}") for c in cols), *cells)
        d2 = reduce(lambda p, q: p + q, ((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in cols))
        met = left.join(right, [*keys, *(f"g{c}" for c in cols)]).filter("a <> b").withColumn("d", F.sqrt(d2)).filter(F.col("d") <= reach)
        ranked = met.select(*keys, "a", "b", "d").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        last = reach > span or reach >= most
        near = settled(ranked.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "a"))))
        full = near if last else near.filter(F.col("n") == k)
        found = full.drop("n") if found is None else found.union(full.drop("n"))
        if last:
            return found
        done = full.filter("rank = 1").select(*keys, F.col("a").alias("point_id"))
        todo = settled(todo.join(done, [*keys, "point_id"], "left_anti"))
        if todo.isEmpty():
            return found
        reach = min(reach * 2, most)


def fitting_reach(points: DataFrame, reach: float, few: int) -> float:
    """A first reach for growing rings, ``reach`` at most: less where cells of that side hold more than ``few`` others a point."""
    held = points.groupBy("scan_id", *(cell(c, reach) for c in "xyz")).agg(F.count("*").cast("double").alias("n"))
    others = held.agg(F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).first()[0] or 0.0
    return reach * min(1.0, (few / others) ** (1 / 3)) if others else reach


def statistical_outliers(points: DataFrame, k: int = 20, ratio: float = 1.6, reach: float = 0.1) -> DataFrame:
    """(scan_id, point_id, mean_d, outlier): mean distance to the ``k`` nearest against mean + ``ratio`` deviations of the scan."""
    p = settled(points)
    m = nearest(p, p, k, fitting_reach(p, reach, k)).groupBy("scan_id", F.col("a").alias("point_id")).agg(F.avg("d").alias("mean_d"))
    limit = m.groupBy("scan_id").agg((F.avg("mean_d") + ratio * F.stddev_samp("mean_d")).alias("limit"))
    return m.join(limit, "scan_id").select("scan_id", "point_id", "mean_d", (F.col("mean_d") > F.col("limit")).alias("outlier"))


def set_gaps(points: DataFrame, label: str, reach: float, most: float = float("inf")) -> DataFrame:
    """(scan_id, la, lb, gap; la < lb): least distance between the point sets of two labels of a scan.

    Pairs of labels that meet within ``reach`` are done; those that are still
    apart try again with twice the reach. No gap over ``most`` is looked for.
    """
    points = settled(points.select("scan_id", "point_id", label, *"xyz"))
    reach = fitting_reach(points, reach, 4)
    labels = points.select("scan_id", F.col(label).alias("l")).distinct()
    todo = settled(labels.withColumnRenamed("l", "la").join(labels.withColumnRenamed("l", "lb"), "scan_id").filter("la < lb"))
    found = None
    while reach <= most and not todo.isEmpty():
        a, b = points.select("scan_id", "point_id", F.col(label).alias("la"), "x", "y", "z"), points.select("scan_id", "point_id", F.col(label).alias("lb"), "x", "y", "z")
        left = a.join(todo.select("scan_id", "la").distinct(), ["scan_id", "la"]).select("scan_id", "la", *(F.col(c).alias(f"a{c}") for c in "xyz"), *(cell(c, reach).alias(f"g{c}") for c in "xyz"))
        for c in "xyz":
            left = left.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + j for j in (-1, 0, 1)))))
        right = b.join(todo.select("scan_id", "lb").distinct(), ["scan_id", "lb"]).select("scan_id", "lb", *(F.col(c).alias(f"b{c}") for c in "xyz"), *(cell(c, reach).alias(f"g{c}") for c in "xyz"))
        d2 = reduce(lambda p, q: p + q, ((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"))
        near = left.join(right, ["scan_id", "gx", "gy", "gz"]).filter("la < lb").groupBy("scan_id", "la", "lb").agg(F.sqrt(F.min(d2)).alias("gap")).filter(F.col("gap") <= reach)
        near = settled(near.join(todo, ["scan_id", "la", "lb"], "left_semi"))
        found = near if found is None else found.union(near)
        todo, reach = settled(todo.join(near, ["scan_id", "la", "lb"], "left_anti")), reach * 2
    return found if found is not None else todo.withColumn("gap", F.lit(0.0))


def voxel_mean(points: DataFrame, size: float) -> DataFrame:
    """One mean point per voxel."""
    return points.groupBy("scan_id", *(cell(c, size).alias(f"v{c}") for c in "xyz")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


def principal_angle(x: str, y: str) -> Column:
    """Direction of the 2D principal axis, as an aggregate, in (-pi/2, pi/2]."""
    return 0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))


def rasterised(boxes: DataFrame, size: float) -> DataFrame:
    """(scan_id, box_id, row, col): cells whose centre lies in the turned rectangle of a box."""
    reach = F.hypot("sx", "sy") / 2
    span = lambda c: F.sequence(cell(F.col(c) - reach, size), cell(F.col(c) + reach, size))
    d = boxes.withColumn("col", F.explode(span("cx"))).withColumn("row", F.explode(span("cy")))
    dx, dy = (F.col("col") + 0.5) * size - F.col("cx"), (F.col("row") + 0.5) * size - F.col("cy")
    c, s = F.cos("yaw"), F.sin("yaw")
    inside = (F.abs(c * dx + s * dy) <= F.col("sx") / 2) & (F.abs(c * dy - s * dx) <= F.col("sy") / 2)
    return d.filter(inside).select("scan_id", "box_id", "row", "col")
