"""Measured objects of a semantic space: geometry in the room's frame, relations, rescaling.

An object is one record: its reasons, centre, axes, oriented box, footprint,
sizes and confidence. What a group of points adds up to (quantiles, medians,
moments, neighbour distances) is aggregated by Spark; no group meets in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitrace.operators import spatial, tracks
from habitrace.session import settled

#: Least points, share of the extent from which a main cluster is suspicious, what a compact cluster is next to it, how sparse is diffuse.
LEAST, SUSPICIOUS, SMALLER, DENSER, DIFFUSE = 20, 0.85, 0.5, 3.0, 2.5

LENGTHS = ("length", "width", "height", "top_height", "top_height_high")


def _local(k: int) -> Column:
    """Coordinate ``k`` of (x, y, z) in the frame (``origin``, ``axes``: three axes one after the other)."""
    return sum(((F.col(c) - F.col("origin")[i]) * F.col("axes")[3 * k + i] for i, c in ((1, "y"), (2, "z"))), (F.col("x") - F.col("origin")[0]) * F.col("axes")[3 * k])


def _extent(names: tuple[str, str, str]) -> Column:
    """Length of the diagonal of three pairs of quantiles."""
    return F.sqrt(sum(((F.col(c)[1] - F.col(c)[0]) ** 2 for c in names[1:]), (F.col(names[0])[1] - F.col(names[0])[0]) ** 2))


def _quantiles(name: str, *at: float) -> Column:
    return F.percentile(name, F.array(*map(F.lit, at)))


def _trimmed(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Points without the outermost 0.5 % of each axis, and without the lowest ones above the floor."""
    ends = points.groupBy("scan_id").agg(*(_quantiles(c, 0.005, 0.995).alias(f"q{c}") for c in "xyz"))
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(c).between(F.col(f"q{c}")[0], F.col(f"q{c}")[1])
    own = settled(points.join(ends, "scan_id").filter(inside).join(frames, "scan_id", "left").select("scan_id", "point_id", "x", "y", "z", _local(2).alias("up")))
    low = own.groupBy("scan_id").agg(F.percentile("up", 0.005).alias("cut"))
    return own.join(low, "scan_id").filter("up is null or up > cut - 1e-9").select("scan_id", "point_id", "x", "y", "z")


def clusters(points: DataFrame, reach: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(points with component; a row per component: size, extent, spacing, rank, and its scan's overall extent).

    ``spacing`` is the median distance to the third neighbour inside the
    component, null for a single point; ``rank`` is by size, then number.
    """
    found = tracks.dense_components(points).select("scan_id", "point_id", "component")
    own = settled(points.join(found, ["scan_id", "point_id"]))
    third = spatial.nearest(own, own, 3, reach, keys=("scan_id", "component")).groupBy("scan_id", "component", "a").agg(F.max("d").alias("d"))
    spacing = third.groupBy("scan_id", "component").agg(F.median("d").alias("spacing"))
    shape = own.groupBy("scan_id", "component").agg(F.count("*").alias("size"), *(_quantiles(c, 0.02, 0.98).alias(f"q{c}") for c in "xyz"))
    whole = own.groupBy("scan_id").agg(*(_quantiles(c, 0.02, 0.98).alias(f"w{c}") for c in "xyz")).select("scan_id", _extent(("wx", "wy", "wz")).alias("overall"))
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("size"), "component"))
    each = shape.select("scan_id", "component", "size", _extent(("qx", "qy", "qz")).alias("extent")).join(spacing, ["scan_id", "component"], "left").join(whole, "scan_id")
    return own, settled(each.withColumn("rank", rank))


def chosen_cluster(parts: DataFrame) -> DataFrame:
    """(scan_id, clusters, component, size, spacing): the cluster to measure; component null where none is compact.

    The largest, unless it reaches over nearly the whole instance while there
    are others: then the first other one by size that is not tiny, at most half
    as wide and three times as dense.
    """
    main = parts.filter("rank = 1").select("scan_id", F.struct("component", "size", "spacing").alias("main"), F.col("extent").alias("m_extent"), "overall")
    count = parts.groupBy("scan_id").agg(F.count("*").alias("clusters"))
    other = parts.filter("rank > 1").join(main, "scan_id")
    fits = (F.col("size") >= F.greatest(F.lit(LEAST), F.floor(0.05 * F.col("main.size")))) & (F.col("extent") < SMALLER * F.col("m_extent")) & (F.col("spacing") < F.col("main.spacing") / DENSER)
    rescued = other.filter(fits).groupBy("scan_id").agg(F.min_by(F.struct("component", "size", "spacing"), "rank").alias("rescued"))
    j = main.join(count, "scan_id").join(rescued, "scan_id", "left")
    suspicious = (F.col("clusters") > 1) & (F.col("m_extent") / F.greatest("overall", F.lit(1e-9)) > SUSPICIOUS)
    return j.select("scan_id", "clusters", F.when(suspicious, F.col("rescued")).otherwise(F.col("main")).alias("c")).select("scan_id", "clusters", "c.*")


def _vector(parts: list[Column]) -> Column:
    return F.array(*parts)


def measured(points: DataFrame, frames: DataFrame, spacing: DataFrame | None = None) -> DataFrame:
    """One record per instance: status, reason, counts, centre, axes, corners, footprint, sizes and confidence.

    ``points`` (instance_id, point_id, x, y, z), ``frames`` (instance_id,
    origin, axes: right, ahead and up one after the other), ``spacing``
    (instance_id, scene_spacing: the low quantile of neighbour distances of the
    whole scene). ``status`` is ok or insufficient, with the first reason of:
    too_few_points, no_compact_cluster, diffuse_cluster,
    room_frame_unavailable, degenerate_extent; then there is no geometry.
    ``stability`` is the mean share by which the middle 80 % of each
    horizontal extent falls short of 98 %. Points with a null or non-finite
    coordinate count for nothing; an instance without points has no row.
    """
    p = settled(points.filter(spatial.finite("x", "y", "z")).select(F.col("instance_id").alias("scan_id"), "point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    f = settled(frames.select(F.col("instance_id").alias("scan_id"), "origin", "axes"))
    counts = settled(p.groupBy("scan_id").agg(F.count("*").alias("points")))
    enough = p.join(counts.filter(F.col("points") >= LEAST).select("scan_id"), "scan_id", "left_semi")
    own, parts = clusters(settled(_trimmed(enough, f)))
    chosen = settled(chosen_cluster(parts))
    scene = spacing.select(F.col("instance_id").alias("scan_id"), "scene_spacing") if spacing is not None else chosen.select("scan_id", F.lit(None).cast("double").alias("scene_spacing"))
    selected = own.join(chosen.select("scan_id", "component"), ["scan_id", "component"]).join(f, "scan_id")
    local = settled(selected.select("scan_id", *"xyz", *(_local(k).alias(c) for k, c in enumerate("uvw"))))
    middle = local.groupBy("scan_id").agg(*(F.median(c).alias(f"m{c}") for c in "xyzuvw"), _quantiles("w", 0.005, 0.995, 0.9, 0.99).alias("qw"))
    about = local.join(middle, "scan_id").withColumns({"du": F.col("u") - F.col("mu"), "dv": F.col("v") - F.col("mv")})
    turn = about.groupBy("scan_id").agg((0.5 * F.atan2(2 * F.sum(F.col("du") * F.col("dv")), F.sum(F.col("du") ** 2) - F.sum(F.col("dv") ** 2))).alias("turn"))
    c, s = F.cos("turn"), F.sin("turn")
    along = about.join(turn, "scan_id").select("scan_id", (c * F.col("du") + s * F.col("dv")).alias("a"), (c * F.col("dv") - s * F.col("du")).alias("b"))
    spans = along.groupBy("scan_id").agg(*(_quantiles(k, 0.01, 0.99, 0.1, 0.9).alias(f"q{k}") for k in "ab"))
    g = middle.join(turn, "scan_id").join(spans, "scan_id").join(f, "scan_id")
    ext = lambda k, i: F.col(f"q{k}")[i + 1] - F.col(f"q{k}")[i]
    g = g.withColumns({"ea": ext("a", 0), "eb": ext("b", 0), "tall": F.col("qw")[1] - F.col("qw")[0]})
    fall = lambda k, e: F.abs(F.col(e) - ext(k, 2)) / F.greatest(F.col(e), F.lit(1e-9))
    swap = F.col("eb") > F.col("ea")
    g = g.withColumns({"stability": (fall("a", "ea") + fall("b", "eb")) / 2, "length": F.greatest("ea", "eb"), "width": F.least("ea", "eb"), "lu": F.when(swap, -s).otherwise(c), "lv": F.when(swap, c).otherwise(s)})
    # the long axis points to the side that the object's middle lies on
    seat = [sum(((F.col(f"m{x}") - F.col("origin")[i]) * F.col("axes")[3 * k + i] for i, x in ((1, "y"), (2, "z"))), (F.col("mx") - F.col("origin")[0]) * F.col("axes")[3 * k]) for k in (0, 1)]
    g = g.withColumns({"hu": seat[0], "hv": seat[1]})
    sign = F.when(F.col("lu") * F.col("hu") + F.col("lv") * F.col("hv") < 0, -1.0).otherwise(1.0)
    g = g.withColumns({f"l{x}": sign * (F.col("axes")[i] * F.col("lu") + F.col("axes")[3 + i] * F.col("lv")) for i, x in enumerate("xyz")} | {f"u{x}": F.col("axes")[6 + i] for i, x in enumerate("xyz")})
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    g = g.withColumns({f"s{x}": F.col(f"u{p_}") * F.col(f"l{q_}") - F.col(f"u{q_}") * F.col(f"l{p_}") for x, (p_, q_) in cross.items()})
    g = g.withColumns({f"b{x}": F.col("origin")[i] + F.col("hu") * F.col("axes")[i] + F.col("hv") * F.col("axes")[3 + i] for i, x in enumerate("xyz")})
    at = lambda x, p_, q_, r_: F.col(f"b{x}") + p_ / 2 * F.col("length") * F.col(f"l{x}") + q_ / 2 * F.col("width") * F.col(f"s{x}") + r_ * F.col(f"u{x}")
    foot = F.array(*(_vector([at(x, p_, q_, F.lit(0.0)) for x in "xyz"]) for p_ in (-1.0, 1.0) for q_ in (-1.0, 1.0)))
    solid = F.array(*(_vector([at(x, p_, q_, F.col("mw") + r_ / 2 * F.col("tall")) for x in "xyz"]) for p_ in (-1.0, 1.0) for q_ in (-1.0, 1.0) for r_ in (-1.0, 1.0)))
    shape = g.select(
        "scan_id", "stability", "length", "width", F.col("tall").alias("height"), F.greatest(F.col("qw")[2], F.lit(0.0)).alias("top_height"), F.greatest(F.col("qw")[3], F.lit(0.0)).alias("top_height_high"),
        _vector([F.col(f"m{x}") for x in "xyz"]).alias("center"), _vector([F.col(f"{k}{x}") for k in "lsu" for x in "xyz"]).alias("object_axes"), foot.alias("footprint"), solid.alias("corners"),
        (F.col("length") * F.col("width")).alias("area"),
    )
    j = counts.join(chosen, "scan_id", "left").join(scene, "scan_id", "left").join(f.select("scan_id", F.lit(True).alias("framed")), "scan_id", "left").join(shape, "scan_id", "left")
    reason = (
        F.when(F.col("points") < LEAST, "too_few_points")
        .when(F.col("component").isNull(), "no_compact_cluster")
        .when((F.col("scene_spacing") > 0) & (F.col("spacing") > DIFFUSE * F.col("scene_spacing")), "diffuse_cluster")
        .when(F.col("framed").isNull(), "room_frame_unavailable")
        .when(F.least("width", "height") <= 1e-5, "degenerate_extent")
    )
    retained = F.col("size") / F.col("points")
    sure = F.when((F.col("size") >= 150) & (retained >= 0.45) & (F.col("stability") <= 0.20), "high").when((F.col("size") >= 50) & (retained >= 0.25), "medium").otherwise("low")
    j = j.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    kept = ("stability", "center", "object_axes", "corners", "footprint", "area", *LENGTHS)
    return j.select(
        F.col("scan_id").alias("instance_id"), F.when(ok, "ok").otherwise("insufficient").alias("status"), "reason", "points", F.when(ok, F.col("size")).otherwise(0).alias("cleaned"),
        F.when(ok, retained).otherwise(0.0).alias("retained"), F.when(ok, F.col("clusters")).otherwise(0).alias("clusters"), *(F.when(ok, F.col(k)).alias(k) for k in kept), F.when(ok, sure).otherwise("unknown").alias("confidence"),
    )


def rescaled(objects: DataFrame, scale: float) -> DataFrame:
    """``objects`` (of ``measured``) in another unit: places and lengths by ``scale``, areas by its square, shares and axes as they are."""
    if not (math.isfinite(scale) and scale > 0):
        raise ValueError("the scale must be positive and finite")
    by = lambda v: v * F.lit(float(scale))
    new = {k: by(F.col(k)) for k in LENGTHS} | {"area": by(by(F.col("area"))), "center": F.transform("center", by)} | {k: F.transform(k, lambda corner: F.transform(corner, by)) for k in ("corners", "footprint")}
    return objects.withColumns(new)


def relations(objects: DataFrame, k: int = 2, reach: float = 1.0) -> DataFrame:
    """(scan_id, instance_id, rank, other_id, center_distance, footprint_gap): the ``k`` nearest objects of each, by centres.

    ``objects`` (scan_id, instance_id, center, footprint); those without a
    centre have no relations. The gap is the least distance between corners of
    the footprints, null where either has none. Objects meet by cells of a
    growing ring, not all with all; ties go to the lower number.
    """
    seated = settled(objects.filter(F.col("center").isNotNull()).select("scan_id", F.col("instance_id").alias("point_id"), *(F.col("center")[i].alias(c) for i, c in enumerate("xyz")), "footprint"))
    near = spatial.nearest(seated, seated, k, reach)
    foot = lambda side: seated.select("scan_id", F.col("point_id").alias(side), F.col("footprint").alias(f"f{side}"))
    j = near.join(foot("a"), ["scan_id", "a"]).join(foot("b"), ["scan_id", "b"])
    apart = lambda p, q: F.sqrt(sum(((p[i] - q[i]) * (p[i] - q[i]) for i in (1, 2)), (p[0] - q[0]) * (p[0] - q[0])))
    gap = F.array_min(F.flatten(F.transform("fa", lambda p: F.transform("fb", lambda q: apart(p, q)))))
    return j.select("scan_id", F.col("a").alias("instance_id"), "rank", F.col("b").alias("other_id"), F.round("d", 4).alias("center_distance"), F.round(gap, 4).alias("footprint_gap"))
