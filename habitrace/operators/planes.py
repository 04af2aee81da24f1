"""Planes, hulls and directions of point sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitrace.operators import spatial
from habitrace.session import settled

SLOTS = 4096


def _draws(points: DataFrame, trials: int, seed: int) -> DataFrame:
    """(scan_id, trial, p0, p1, p2): three seeded points a trial.

    Points are dealt to ``SLOTS`` slots of their scan by a hash, each slot
    keeps its least point, and a trial draws three slots that are taken: the
    draw costs one aggregation of the points, whatever the number of trials.
    """
    slot = F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(SLOTS))
    held = points.groupBy("scan_id", slot.alias("slot")).agg(F.min_by(F.struct("x", "y", "z"), "point_id").alias("p"))
    placed = settled(held.select("scan_id", "p", (F.row_number().over(Window.partitionBy("scan_id").orderBy("slot")) - 1).alias("place")))
    size = placed.groupBy("scan_id").agg(F.count("*").alias("n"))
    asked = size.select("scan_id", "n", F.explode(F.sequence(F.lit(0), F.lit(3 * trials - 1))).alias("i"))
    wanted = asked.select("scan_id", F.floor(F.col("i") / 3).cast("int").alias("trial"), (F.col("i") % 3).alias("k"), F.pmod(F.xxhash64("scan_id", "i", F.lit(seed)), F.col("n")).cast("int").alias("place"))
    drawn = wanted.join(placed, ["scan_id", "place"]).groupBy("scan_id", "trial")
    return drawn.agg(*(F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}") for k in range(3)))


def hypotheses(points: DataFrame, trials: int = 500, seed: int = 7) -> DataFrame:
    """(scan_id, trial, p0, nx, ny, nz, d): unit normals and offsets of planes through three drawn points."""
    of = lambda k, c: F.col(f"p{k}.{c}") - F.col(f"p0.{c}")
    cross = {"nx": of(1, "y") * of(2, "z") - of(1, "z") * of(2, "y"), "ny": of(1, "z") * of(2, "x") - of(1, "x") * of(2, "z"), "nz": of(1, "x") * of(2, "y") - of(1, "y") * of(2, "x")}
    norm = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    found = _draws(points, trials, seed).select("scan_id", "trial", "p0", *(v.alias(k) for k, v in cross.items())).withColumn("norm", norm).filter("norm > 1e-9")
    unit = found.select("scan_id", "trial", "p0", *((F.col(c) / F.col("norm")).alias(c) for c in cross))
    return unit.select("scan_id", "trial", "p0", "nx", "ny", "nz", (F.col("nx") * F.col("p0.x") + F.col("ny") * F.col("p0.y") + F.col("nz") * F.col("p0.z")).alias("d"))


def ransac(points: DataFrame, trials: int = 500, threshold: float = 0.03, seed: int = 7) -> DataFrame:
    """(scan_id, trial, inliers, nx, ny, nz, d): per scan the plane that most points are within ``threshold`` of.

    The reference values are 500 to 800 trials. Every point is held against
    every hypothesis of its scan; counts are combined before they are shuffled.
    The first trial wins ties; a scan with fewer than three places has no row.
    """
    planes = settled(hypotheses(points, trials, seed))
    away = F.abs(F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz") - F.col("d"))
    counts = points.select("scan_id", "x", "y", "z").join(planes, "scan_id").filter(away <= threshold).groupBy("scan_id", "trial").agg(F.count("*").alias("inliers"))
    best = counts.groupBy("scan_id").agg(F.max_by(F.struct("trial", "inliers"), F.struct("inliers", (-F.col("trial")).alias("t"))).alias("b")).select("scan_id", "b.trial", "b.inliers")
    return best.join(planes, ["scan_id", "trial"]).select("scan_id", "trial", "inliers", "nx", "ny", "nz", "d")


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; all points where they are too few or in line."""
    points = np.unique(xy, axis=0)
    if len(points) < 3:
        return points

    def half(rows: np.ndarray) -> list:
        kept: list = []
        for p in rows:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(half(points) + half(points[::-1]))


def rectangle_of(corners: np.ndarray) -> tuple[float, float, float]:
    """(length, width, angle) of the least-area rectangle around a hull: one side lies on an edge."""
    edges = np.roll(corners, -1, axis=0) - corners
    best = (0.0, 0.0, 0.0)
    for i, angle in enumerate(np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 12))):
        c, s = np.cos(angle), np.sin(angle)
        a, b = np.ptp(corners @ [c, s]), np.ptp(corners @ [-s, c])
        if i == 0 or a * b < best[0] * best[1]:
            best = (max(a, b), min(a, b), float(angle))
    return best


def min_area_rectangles(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length, width, angle) per group.

    Each task takes the hull of what it holds of a group, so only corners of
    partial hulls are shuffled; a group's rectangle comes from their hull.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in points.select(*keys).dtypes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                corners = hull(group[["x", "y"]].to_numpy(float))
                yield pd.DataFrame(dict(zip(keys, key)) | {"x": corners[:, 0], "y": corners[:, 1]})

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *rectangle_of(hull(group[["x", "y"]].to_numpy(float))))])

    corners = points.select(*keys, "x", "y").mapInPandas(partial, f"{kinds}, x double, y double")
    return corners.groupBy(*keys).applyInPandas(whole, f"{kinds}, length double, width double, angle double")


def _least_direction(cov: pd.Series) -> pd.DataFrame:
    """The direction of least variance of each 3 x 3 covariance, turned upwards; straight up where there is none."""
    m = np.stack([np.array(c if c is not None else [0.0] * 9, float) for c in cov]).reshape(-1, 3, 3)
    n = np.linalg.eigh(m)[1][:, :, 0]
    n = np.where(n[:, 2:3] < 0, -n, n)
    n[[c is None for c in cov]] = (0.0, 0.0, 1.0)
    return pd.DataFrame(n, columns=["nx", "ny", "nz"])


def normals(points: DataFrame, most: int = 30, share: float = 0.15, least: float = 0.02) -> DataFrame:
    """(scan_id, point_id, x, y, z, n, nx, ny, nz): one row a point, its normal from at most ``most`` nearest points.

    Neighbours (the point itself is one) lie within a radius that follows each
    scan's own spread: ``share`` of the 90 % quantile of the distances from its
    median point, ``least`` at least. Points meet by cells of that size; the
    nearest are chosen as they are met, before neighbours are shuffled. A point
    with fewer than three neighbours gets the normal straight up; ties of
    distance go to the lower point_id. Points with a null or non-finite
    coordinate have no row; an empty cloud gives none.
    """
    p = settled(points.filter(spatial.finite("x", "y", "z")).select("scan_id", "point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    middle = p.groupBy("scan_id").agg(*(F.median(c).alias(f"m{c}") for c in "xyz"))
    off = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("mx")) ** 2))
    radius = p.join(middle, "scan_id").groupBy("scan_id").agg(F.greatest(F.percentile(off, 0.9) * share + 1e-4, F.lit(least)).alias("radius"))
    placed = settled(p.join(radius, "scan_id").select("*", *(F.floor(F.col(c) / F.col("radius")).cast("bigint").alias(f"g{c}") for c in "xyz")))
    left = placed.select("scan_id", F.col("point_id").alias("a"), "radius", *(F.col(c).alias(f"a{c}") for c in "xyz"), "gx", "gy", "gz")
    for c in "xyz":
        left = left.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + j for j in (-1, 0, 1)))))
    right = placed.select("scan_id", F.col("point_id").alias("b"), "x", "y", "z", "gx", "gy", "gz")
    d = F.sqrt(sum(((F.col(c) - F.col(f"a{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("ax")) ** 2))
    met = left.join(right, ["scan_id", "gx", "gy", "gz"]).select("scan_id", "a", "b", "x", "y", "z", "radius", d.alias("d")).filter("d <= radius")
    near = met.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id", "a").orderBy("d", "b"))).filter(F.col("rank") <= most)
    moments = near.groupBy("scan_id", F.col("a").alias("point_id")).agg(F.count("*").alias("n"), F.array(*(F.covar_pop(a, b) for a in "xyz" for b in "xyz")).alias("cov"))
    turned = moments.select("scan_id", "point_id", "n", F.pandas_udf(_least_direction, "nx double, ny double, nz double")(F.when(F.col("n") >= 3, F.col("cov"))).alias("v"))
    return p.join(turned, ["scan_id", "point_id"]).select("scan_id", "point_id", "x", "y", "z", "n", "v.*")


def without_ceiling(points: DataFrame, top: float = 0.92, lowest: float = 0.88, threshold: float = 0.025, trials: int = 700, band: float = 0.20, upright: float = 0.82, flat: float = 0.88, most: int = 30, seed: int = 7) -> DataFrame:
    """(scan_id, point_id, removed, ceiling): every point, and whether it is ceiling.

    The plane that most of a scan's highest points (from the ``top`` quantile
    of height on) lie in is a ceiling if it is level (``flat``) and not below
    the ``lowest`` quantile; ``ceiling`` is its height, null where there is
    none. Of the highest points those go that are at most ``band`` under it and
    whose normal among the highest points is near vertical (``upright``). All
    other points stay, with or without neighbours.
    """
    p = settled(points.select("scan_id", "point_id", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    cuts = p.groupBy("scan_id").agg(F.percentile("z", F.array(F.lit(top), F.lit(lowest))).alias("q"))
    high = settled(p.join(cuts, "scan_id").filter(F.col("z") >= F.col("q")[0]).select("scan_id", "point_id", "x", "y", "z"))
    plane = ransac(high, trials, threshold, seed).select("scan_id", F.abs("nz").alias("level"), (F.col("d") / F.col("nz")).alias("ceiling"))
    found = plane.join(cuts, "scan_id").filter((F.col("level") >= flat) & (F.col("ceiling") >= F.col("q")[1])).select("scan_id", "ceiling")
    up = normals(high, most).join(found, "scan_id").filter((F.col("nz") >= upright) & (F.col("z") >= F.col("ceiling") - band)).select("scan_id", "point_id", F.lit(True).alias("removed"))
    return p.select("scan_id", "point_id").join(up, ["scan_id", "point_id"], "left").join(found, "scan_id", "left").select("scan_id", "point_id", F.coalesce("removed", F.lit(False)).alias("removed"), "ceiling")


def direction_grid(step: int) -> list[tuple[int, float, float, float]]:
    """(number, x, y, z) of a half sphere's directions, ``step`` degrees apart."""
    turns = [(np.radians(t), np.radians(f)) for t in range(0, 91, step) for f in range(0, 360, step)]
    return [(i, float(np.sin(t) * np.cos(f)), float(np.sin(t) * np.sin(f)), float(np.cos(t))) for i, (t, f) in enumerate(turns)]


def direction_mode(normals: DataFrame, step: int = 10, cone: float = 15.0) -> DataFrame:
    """(scan_id, i, n): the grid direction with most normals (either way round) within its cone; the first wins ties."""
    dot = lambda d: F.abs(F.col("nx") * d["x"] + F.col("ny") * d["y"] + F.col("nz") * d["z"])
    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for i, x, y, z in direction_grid(step)))
    near = F.transform(F.filter(grid, lambda d: dot(d) >= float(np.cos(np.radians(cone)))), lambda d: d["i"])
    counts = normals.select("scan_id", F.explode(near).alias("i")).groupBy("scan_id", "i").agg(F.count("*").alias("n"))
    return counts.groupBy("scan_id").agg(F.min_by(F.struct("i", "n"), F.struct((-F.col("n")).alias("m"), "i")).alias("b")).select("scan_id", "b.i", "b.n")


def _outer(points: DataFrame) -> DataFrame:
    """Points that can end a widest pair: ``r`` from the middle of a wide pair, with the farthest of all beyond its length."""
    away = lambda at: F.sqrt(sum(((F.col(c) - F.col(f"{at}.{c}")) ** 2 for c in "yz"), (F.col("x") - F.col(f"{at}.x")) ** 2))
    ends = points.groupBy("scan_id").agg(F.struct(*(F.avg(c).alias(c) for c in "xyz")).alias("a"))
    for old, new in ("ab", "bc", "cd"):
        found = points.join(ends, "scan_id").groupBy("scan_id").agg(F.max_by(F.struct("x", "y", "z"), away(old)).alias(new))
        ends = found if new != "d" else ends.join(found, "scan_id")
    length = F.sqrt(sum((F.col(f"c.{k}") - F.col(f"d.{k}")) ** 2 for k in "xyz"))
    ends = settled(ends.select("scan_id", length.alias("length"), F.struct(*(((F.col(f"c.{k}") + F.col(f"d.{k}")) / 2).alias(k) for k in "xyz")).alias("m")))
    placed = points.join(ends, "scan_id").select("scan_id", "x", "y", "z", "length", away("m").alias("r"))
    inner = placed.groupBy("scan_id").agg((F.max("length") - F.max("r") - 1e-9).alias("inner"))
    return placed.join(inner, "scan_id").filter("r >= inner").select("scan_id", "x", "y", "z")


def widest_pairs(points: DataFrame, sizes: tuple[float, ...] = (0.25, 0.04)) -> DataFrame:
    """(scan_id, widest): the greatest distance between two points of a scan, exactly.

    Points meet by cells, coarse to fine: a pair of cells is followed only if
    the farthest points that it could hold are at least as far apart as the
    nearest ones of the best pair, so only points near the ends are compared.
    Points too near the middle for any pair as wide as one that is known go first.
    """
    work, pairs = settled(_outer(points.select("scan_id", "x", "y", "z"))), None
    for size in sizes:
        own = [F.floor(F.col(c) / size).cast("bigint").alias(f"g{c}") for c in "xyz"]
        cell = F.struct(*own)
        cells = work.select("scan_id", cell.alias("cell"), *([] if pairs is None else ["up"])).distinct()
        middle = lambda s, c: (F.col(f"{s}.cell.g{c}") + 0.5) * size
        a, b = cells.alias("a"), cells.alias("b")
        if pairs is None:
            met = a.join(b, (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.cell") <= F.col("b.cell")))
        else:
            p = pairs.alias("p")
            met = p.join(a, (F.col("p.scan_id") == F.col("a.scan_id")) & (F.col("p.ca") == F.col("a.up"))).join(b, (F.col("p.scan_id") == F.col("b.scan_id")) & (F.col("p.cb") == F.col("b.up")))
        d = F.sqrt(sum(((middle("a", c) - middle("b", c)) ** 2 for c in "yz"), (middle("a", "x") - middle("b", "x")) ** 2))
        far = settled(met.select(F.col("a.scan_id").alias("scan_id"), F.col("a.cell").alias("ca"), F.col("b.cell").alias("cb"), d.alias("d")).distinct())
        floor = far.groupBy("scan_id").agg((F.max("d") - size * 3**0.5).alias("floor"))
        pairs = settled(far.join(floor, "scan_id").filter(F.col("d") + size * 3**0.5 >= F.col("floor")).select("scan_id", "ca", "cb"))
        ends = pairs.select("scan_id", F.col("ca").alias("up")).union(pairs.select("scan_id", F.col("cb").alias("up"))).distinct()
        work = settled(work.select("scan_id", "x", "y", "z", cell.alias("up")).join(ends, ["scan_id", "up"]))
    p, a, b = pairs.alias("p"), work.alias("a"), work.alias("b")
    met = p.join(a, (F.col("p.scan_id") == F.col("a.scan_id")) & (F.col("p.ca") == F.col("a.up"))).join(b, (F.col("p.scan_id") == F.col("b.scan_id")) & (F.col("p.cb") == F.col("b.up")))
    d = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "yz"), (F.col("a.x") - F.col("b.x")) ** 2))
    return met.groupBy(F.col("p.scan_id").alias("scan_id")).agg(F.max(d).alias("widest"))


def floor_plane(points: DataFrame, keep: float = 0.9) -> DataFrame:
    """(scan_id, a, b, c, slope): the least-squares plane z = ax + by + c, fitted again on the best ``keep`` of the points."""

    def fit(p: DataFrame) -> DataFrame:
        m = p.groupBy("scan_id").agg(F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"), *(F.avg(c).alias(f"m{c}") for c in "xyz"))
        det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
        m = m.withColumns({"a": F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det), "b": F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det)})
        return m.select("scan_id", "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))

    p = points.select("scan_id", "x", "y", "z")
    off = p.join(fit(p), "scan_id").withColumn("e", F.abs(F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c"))).select("scan_id", "x", "y", "z", "e")
    cut = off.groupBy("scan_id").agg(F.percentile("e", keep).alias("cut"))
    return fit(off.join(cut, "scan_id").filter("e <= cut")).withColumn("slope", F.hypot("a", "b"))


def _procrustes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Scale, rotation and shift of one scan from its moments."""
    r = pdf.iloc[0]
    u, d, vt = np.linalg.svd(np.array(r["cov"], float).reshape(3, 3))
    sign = np.array([1, 1, np.sign(np.linalg.det(u @ vt)) or 1])
    rot = u @ np.diag(sign) @ vt
    scale = float((d * sign).sum() / r["spread"])
    shift = np.array(r["to"], float) - scale * rot @ np.array(r["from"], float)
    return pd.DataFrame({"scan_id": [r["scan_id"]], "scale": [scale], "rotation": [rot.ravel().tolist()], "shift": [shift.tolist()]})


def similarity(pairs: DataFrame, refits: int = 5, keep: float = 0.72) -> DataFrame:
    """(scan_id, scale, rotation, shift): the similarity that takes (x, y, z) to (u, v, w), refitted on the best pairs.

    Moments are aggregated by Spark, only one 3 x 3 matrix a scan meets Python;
    each of ``refits`` rounds keeps the pairs whose residual is within the
    ``keep`` quantile of the round's.
    """
    schema = "scan_id long, scale double, rotation array<double>, shift array<double>"

    def fit(p: DataFrame) -> DataFrame:
        m = p.groupBy("scan_id").agg(F.array(*(F.covar_pop(a, b) for a in "uvw" for b in "xyz")).alias("cov"), (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("spread"), F.array(*(F.avg(c) for c in "xyz")).alias("from"), F.array(*(F.avg(c) for c in "uvw")).alias("to"))
        return settled(m.filter("spread > 0").groupBy("scan_id").applyInPandas(_procrustes, schema))

    rows = pairs.select("scan_id", *"xyzuvw")
    found = fit(rows)
    for _ in range(refits):
        to = lambda i: F.col("scale") * (F.col("rotation")[3 * i] * F.col("x") + F.col("rotation")[3 * i + 1] * F.col("y") + F.col("rotation")[3 * i + 2] * F.col("z")) + F.col("shift")[i]
        e = F.sqrt(sum(((F.col(c) - to(i)) ** 2 for i, c in ((1, "v"), (2, "w"))), (F.col("u") - to(0)) ** 2))
        off = rows.join(found, "scan_id").select("scan_id", *"xyzuvw", e.alias("e"))
        cut = off.groupBy("scan_id").agg(F.percentile("e", keep).alias("cut"))
        found = fit(off.join(cut, "scan_id").filter("e <= cut"))
    return found


def _main_directions(group: pd.DataFrame) -> pd.DataFrame:
    """The strongest horizontal direction of a scan's wall planes and the first that is square to it."""
    g = group.sort_values(["support", "trial"], ascending=[False, True])
    v, weight, heads = g[["nx", "ny", "nz"]].to_numpy(float), g.support.to_numpy(float), []
    for i in range(len(v)):
        fit = next((h for h in heads if abs(v[i] @ v[h[0]]) >= 0.9), None)
        if fit is None:
            heads.append([i, weight[i]])
        else:
            fit[1] += weight[i]
    heads.sort(key=lambda h: (-h[1], h[0]))
    first = v[heads[0][0]]
    square = any(abs(v[h[0]] @ first) < 0.5 for h in heads[1:])
    return pd.DataFrame({"scan_id": [g.scan_id.iloc[0]], "ax": [first[0]], "ay": [first[1]], "az": [first[2]], "method": ["manhattan_walls" if square else "single_wall"]})


def room_frame(points: DataFrame, up: DataFrame, trials: int = 400, seed: int = 42) -> DataFrame:
    """(scan_id, nx, ny, nz, ax, ay, az, ratio, method, confidence): floor normal, horizontal axis and how sure both are.

    ``up`` (scan_id, ux, uy, uz) is the hint of the cameras. A floor has many
    points near it, nearly all on one side, the cloud's mass above it, and lies
    square to the hint; walls are planes square to the floor with 3 % of the
    points. Hypotheses are scored by counts, so nothing but them is shuffled. A
    scan whose best plane has under 4 % or is too steep has no row.
    """
    q = lambda c, at: F.percentile(c, at)
    spread = sum(((q(c, 0.99) - q(c, 0.01)) ** 2 for c in "yz"), (q("x", 0.99) - q("x", 0.01)) ** 2)
    size = settled(points.groupBy("scan_id").agg(F.count("*").alias("n"), F.greatest(F.sqrt(spread) * 0.012, F.lit(1e-4)).alias("near")))
    trial = settled(hypotheses(points, trials, seed).join(size, "scan_id").join(up, "scan_id"))
    off = F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz") - F.col("d")
    turned = off * F.signum(F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz"))
    met = points.select("scan_id", "x", "y", "z").join(trial, "scan_id").select("scan_id", "trial", "near", turned.alias("o"))
    counts = met.groupBy("scan_id", "trial").agg(F.count_if(F.abs("o") <= F.col("near")).alias("inl"), F.count_if(F.col("o") >= -F.col("near")).alias("above"), F.count_if(F.col("o") <= F.col("near")).alias("below"), F.count_if(F.col("o") >= 0).alias("over"))
    j = counts.join(trial, ["scan_id", "trial"])
    align = F.abs(F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz"))
    low = F.when(F.col("over") * 2 >= F.col("n"), 1.0).otherwise(0.15)
    score = F.col("inl") / F.col("n") * (0.5 + 0.5 * F.greatest("above", "below") / F.col("n")) * (0.15 + 0.85 * align * align) * low
    best = j.withColumns({"score": score, "align": align}).groupBy("scan_id").agg(F.max_by(F.struct("nx", "ny", "nz", "ux", "uy", "uz", "inl", "n", "near", "align"), F.struct("score", (-F.col("trial")).alias("t"))).alias("b")).select("scan_id", "b.*")
    best = best.filter((F.col("inl") / F.col("n") >= 0.04) & (F.col("align") >= 0.65))
    side = F.signum(F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz"))
    floor = settled(best.select("scan_id", *((F.col(c) * side).alias(f"f{c[1]}") for c in ("nx", "ny", "nz")), (F.col("inl") / F.col("n")).alias("ratio"), "n", "near"))
    upright = F.col("nx") * F.col("fx") + F.col("ny") * F.col("fy") + F.col("nz") * F.col("fz")
    w = hypotheses(points, trials, seed + 1).join(floor, "scan_id").withColumn("dot", upright).filter(F.abs("dot") <= 0.25)
    flat = {c: F.col(f"n{c}") - F.col("dot") * F.col(f"f{c}") for c in "xyz"}
    length = F.sqrt(sum((flat[c] ** 2 for c in "yz"), flat["x"] ** 2))
    w = w.select("scan_id", "trial", "p0", "n", "near", *((flat[c] / length).alias(f"n{c}") for c in "xyz"))
    w = settled(w.withColumn("d", F.col("nx") * F.col("p0.x") + F.col("ny") * F.col("p0.y") + F.col("nz") * F.col("p0.z")))
    support = points.select("scan_id", "x", "y", "z").join(w, "scan_id").filter(F.abs(off) <= F.col("near")).groupBy("scan_id", "trial").agg(F.count("*").alias("inl"))
    walls = support.join(w, ["scan_id", "trial"]).withColumn("support", F.col("inl") / F.col("n")).filter("support >= 0.03")
    axes = walls.select("scan_id", "trial", "nx", "ny", "nz", "support").groupBy("scan_id").applyInPandas(_main_directions, "scan_id long, ax double, ay double, az double, method string")
    out = floor.join(axes.withColumnRenamed("scan_id", "_scan"), F.col("scan_id") == F.col("_scan"), "left").drop("_scan")
    method = F.coalesce("method", F.lit("none"))
    sure = F.when((F.col("ratio") >= 0.12) & (method == "manhattan_walls"), "high").when((F.col("ratio") >= 0.07) | (method == "single_wall"), "medium").otherwise("low")
    return out.select("scan_id", F.col("fx").alias("nx"), F.col("fy").alias("ny"), F.col("fz").alias("nz"), "ax", "ay", "az", "ratio", method.alias("method"), sure.alias("confidence"))
