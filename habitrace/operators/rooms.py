"""Rooms: alignment, bounds, walls, openings on walls, snapping, placing by rules, distances of turned rectangles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitrace.operators import spatial

#: Walls in order: -y, +x, +y, -x; those of odd number run along y.
WALL_AXES = ((0, "y", "lo"), (1, "x", "hi"), (2, "y", "hi"), (3, "x", "lo"))


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """A value between two bounds; NULL stays NULL."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(value.isNotNull(), F.least(F.greatest(value, as_column(low)), as_column(high)))


def rotation_to_z(dx: Column, dy: Column, dz: Column) -> list[list[Column]]:
    """Rows of the least rotation that turns a direction to +z."""
    n = F.sqrt(dx * dx + dy * dy + dz * dz) + 1e-12
    x, y, c = dx / n, dy / n, dz / n
    v2 = x * x + y * y
    k = (1 - c) / (v2 + 1e-12)
    straight = F.sqrt(v2) < 1e-9
    up = F.when(c > 0, 1.0).otherwise(-1.0)
    full = [[1 - k * x * x, -k * x * y, -x], [-k * x * y, 1 - k * y * y, -y], [x, y, 1 - k * v2]]
    flat = [[F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), up, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), up]]
    return [[F.when(straight, flat[i][j]).otherwise(full[i][j]) for j in range(3)] for i in range(3)]


def rigid_align(rotation: list[list[Column]], floor: Column, scale: Column, x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """Aligned x, y, z: turned, the floor taken off, scaled."""
    turned = [row[0] * F.col(x) + row[1] * F.col(y) + row[2] * F.col(z) for row in rotation]
    return [turned[0] * scale, turned[1] * scale, (turned[2] - floor) * scale]


def bounds(points: DataFrame) -> DataFrame:
    """(scan_id, lo_x, hi_x, lo_y, hi_y, height): first and last percentile; the height is clipped to 1.8 to 4.5 m."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.01), F.lit(0.99)))
    b = points.groupBy("scan_id").agg(q("x").alias("x"), q("y").alias("y"), q("z").alias("z"))
    height = clip(F.col("z")[1] - F.greatest(F.col("z")[0], F.lit(0.0)), 1.8, 4.5)
    return b.select("scan_id", F.col("x")[0].alias("lo_x"), F.col("x")[1].alias("hi_x"), F.col("y")[0].alias("lo_y"), F.col("y")[1].alias("hi_y"), height.alias("height"))


def walls(room: DataFrame, thickness: float = 0.06) -> DataFrame:
    """(scan_id, wall_id, cx, cy, cz, length, thickness, height, rotation): the four walls of the bounds."""
    mid = {a: (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 for a in "xy"}
    side = {a: F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xy"}

    def wall(number: int, axis: str, end: str) -> Column:
        along = "x" if axis == "y" else "y"
        at = {axis: F.col(f"{end}_{axis}"), along: mid[along]}
        return F.struct(F.lit(number).alias("wall_id"), at["x"].alias("cx"), at["y"].alias("cy"), (F.col("height") / 2).alias("cz"), side[along].alias("length"), F.lit(thickness).alias("thickness"), F.col("height").alias("height"), F.lit(0.0 if along == "x" else 90.0).alias("rotation"))

    return room.select("scan_id", F.explode(F.array(*(wall(*w) for w in WALL_AXES))).alias("w")).select("scan_id", "w.*")


def inside_opening(p: dict[str, Column], o: dict[str, Column], margin: float = 0.08) -> Column:
    """A point within an opening of its wall, margins included; walls 1 and 3 run along y."""
    away = F.when(o["wall_id"].isin(1, 3), F.abs(p["y"] - o["cy"])).otherwise(F.abs(p["x"] - o["cx"]))
    return (away <= o["width"] / 2 + margin) & p["z"].between(o["cz"] - o["height"] / 2 - margin, o["cz"] + o["height"] / 2 + margin)


def opening_evidence(points: DataFrame, openings: DataFrame, room: DataFrame, near: float = 0.12, grid: float = 0.5) -> DataFrame:
    """(scan_id, opening_id, wall_id, evidence, surround, opening_points): how much each wall looks open there.

    ``openings`` (scan_id, opening_id, kind, cx, cy, cz, width, height). Points
    within ``near`` of a wall meet the openings by cells along the wall. An
    opening is sparse where its surroundings are dense; a door must be open at
    the floor, a window must have wall below and above.
    """
    at = {w: F.col(f"{end}_{axis}") for w, axis, end in WALL_AXES}
    placed = points.select("scan_id", "x", "y", "z").join(room, "scan_id")
    plane = F.explode(F.array_compact(F.array(*(F.when(F.abs(F.col(axis) - at[w]) < near, F.struct(F.lit(w).alias("wall_id"), F.col("x" if axis == "y" else "y").alias("along"))) for w, axis, _ in WALL_AXES))))
    close = placed.select("scan_id", "z", plane.alias("w")).select("scan_id", "z", "w.*").withColumn("g", spatial.cell("along", grid))
    door = F.col("kind") == "door"
    z0 = F.when(door, 0.03).otherwise(F.greatest(F.lit(0.35), F.col("cz") - F.col("height") / 2))
    z1 = F.when(door, F.least("height", F.lit(2.4))).otherwise(F.col("cz") + F.col("height") / 2)
    each = openings.select("scan_id", "opening_id", "kind", "cx", "cy", "width", z0.alias("z0"), z1.alias("z1"), F.explode(F.array(*(F.lit(w) for w, _, _ in WALL_AXES))).alias("wall_id"))
    each = each.withColumn("middle", F.when(F.col("wall_id").isin(1, 3), F.col("cy")).otherwise(F.col("cx")))
    reach = F.col("width") / 2 + 0.28
    cells = each.withColumn("g", F.explode(F.sequence(spatial.cell(F.col("middle") - reach, grid), spatial.cell(F.col("middle") + reach, grid))))
    met = close.join(cells, ["scan_id", "wall_id", "g"])
    off = F.abs(F.col("along") - F.col("middle"))
    band = off <= F.col("width") / 2
    z, top = F.col("z"), F.least(F.col("z1") + 0.2, F.lit(3.2))
    inside = band & z.between(F.col("z0"), F.col("z1"))
    around = (off <= reach) & ~inside & (z >= 0.03) & (z <= top)
    above = F.least(F.col("z1") + 0.45, F.lit(3.2))
    tests = {"inside": inside, "around": around, "below": band & (z >= 0.03) & (z < F.greatest(F.col("z0") - 0.05, F.lit(0.04))), "above": band & (z > F.col("z1") + 0.05) & (z <= above)}
    counts = met.groupBy("scan_id", "opening_id", "wall_id").agg(*(F.count_if(t).alias(f"n_{k}") for k, t in tests.items()))
    whole = each.join(counts, ["scan_id", "opening_id", "wall_id"], "left").fillna(0, [f"n_{k}" for k in tests])
    area = lambda a: F.greatest(a, F.lit(0.05))
    own = area(F.col("width") * F.greatest(F.col("z1") - F.col("z0"), F.lit(0.2)))
    density = {
        "inside": F.col("n_inside") / own,
        "around": F.col("n_around") / area((F.col("width") + 0.56) * top - own),
        "below": F.col("n_below") / area(F.col("width") * F.greatest(F.col("z0") - 0.08, F.lit(0.05))),
        "above": F.col("n_above") / area(F.col("width") * F.greatest(above - F.col("z1") - 0.05, F.lit(0.05))),
    }
    frame = clip(F.least(density["below"], density["above"]) / 80.0, 0.0, 1.0)
    evidence = density["around"] / (density["inside"] + 20.0) * F.when(F.col("kind") == "door", 1.0 / (1.0 + density["below"] / 40.0)).otherwise(frame)
    return whole.select("scan_id", "opening_id", "wall_id", evidence.alias("evidence"), density["around"].alias("surround"), F.col("n_inside").alias("opening_points"))


def snap_openings(openings: DataFrame, room: DataFrame, evidence: DataFrame) -> DataFrame:
    """(scan_id, opening_id, kind, wall_id, cx, cy, cz, width, height, status): openings put on their wall.

    ``openings`` also has ``preferred``, the wall that the layout names (null
    without one). A window keeps that wall; a door takes the wall that looks
    most open, the first wins ties.
    """
    o = openings.join(room.withColumnRenamed("height", "room"), "scan_id")
    o = o.withColumns({"width": clip(F.col("width"), 0.35, 2.5), "height": clip(F.col("height"), F.lit(0.35), F.col("room"))})
    scored = evidence.groupBy("scan_id", "opening_id").agg(
        F.max_by(F.struct("wall_id", "evidence", "surround", "opening_points"), F.struct("evidence", (-F.col("wall_id")).alias("first"))).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("wall_id", F.struct("wall_id", "evidence", "surround", "opening_points")))).alias("all"),
    )
    j = o.join(scored, ["scan_id", "opening_id"])
    own = F.when((F.col("kind") == "window") & F.col("preferred").isNotNull(), F.element_at("all", F.col("preferred").cast("int"))).otherwise(F.col("best"))
    away = F.element_at(F.array(*(F.abs(F.col(f"c{axis}") - F.col(f"{end}_{axis}")) for _, axis, end in WALL_AXES)), F.col("preferred").cast("int") + 1)
    j = j.withColumns({"own": own, "away": away})
    on_x = F.col("own.wall_id").isin(0, 2)
    half = F.col("width") / 2
    place = lambda a, along: F.when(along, clip(F.col(f"c{a}"), F.col(f"lo_{a}") + half, F.col(f"hi_{a}") - half)).otherwise(F.element_at(F.array(*(F.col(f"{end}_{a}") if axis == a else F.lit(None).cast("double") for _, axis, end in WALL_AXES)), F.col("own.wall_id") + 1))
    j = j.withColumns({"cz": clip(F.col("cz"), F.col("height") / 2, F.col("room") - F.col("height") / 2), "nx": place("x", on_x), "ny": place("y", ~on_x)})
    strict = (F.col("own.surround") >= 30) & (F.col("own.evidence") >= 1.75)
    near = F.coalesce(F.col("away") <= 0.45, F.lit(False))
    bottom, top = F.col("cz") - F.col("height") / 2, F.col("cz") + F.col("height") / 2
    window = (F.col("kind") == "window") & near & F.col("width").between(0.45, 2.5) & F.col("height").between(0.45, 2.0) & (bottom >= 0.35) & (top <= F.col("room") + 0.15) & (F.col("own.surround") >= 10)
    door = (F.col("kind") == "door") & near & F.col("width").between(0.50, 1.25) & F.col("height").between(F.lit(1.50), F.least("room", F.lit(2.40)))
    status = F.when(strict, "verified").when(window | door, "semantic_supported").otherwise("rejected")
    return j.select("scan_id", "opening_id", "kind", F.col("own.wall_id").alias("wall_id"), F.col("nx").alias("cx"), F.col("ny").alias("cy"), "cz", "width", "height", status.alias("status"))


def snap_faces(cx: Column, cy: Column, sx: Column, sy: Column, yaw: Column, room: dict[str, Column], tolerance: float = 0.12, cap_ratio: float = 0.20, cap: float = 0.0) -> Column:
    """struct<cx, cy, sx, sy>: a face that ends just short of a wall it looks at is pushed to the wall; the other face stays.

    Faces are tried in turn (+x, -x, +y, -y of the box), each against the four
    walls, on what the ones before have left.
    """
    c, s = F.cos(yaw), F.sin(yaw)
    tries = [(0, c, s), (0, -c, -s), (1, -s, c), (1, s, -c)]
    steps = F.array(*(F.struct(F.lit(axis).alias("axis"), nx.alias("nx"), ny.alias("ny"), F.lit(wall).alias("wall")) for axis, nx, ny in tries for wall in range(4)))

    def step(state: Column, t: Column) -> Column:
        on_x = t["wall"] < 2
        inward = F.when(t["wall"] % 2 == 0, 1.0).otherwise(-1.0)
        place = F.when(t["wall"] == 0, room["lo_x"]).when(t["wall"] == 1, room["hi_x"]).when(t["wall"] == 2, room["lo_y"]).otherwise(room["hi_y"])
        size = F.when(t["axis"] == 0, state["sx"]).otherwise(state["sy"])
        normal = F.when(on_x, t["nx"]).otherwise(t["ny"])
        face = F.when(on_x, state["cx"]).otherwise(state["cy"]) + normal * size / 2
        toward, gap = -normal * inward, (face - place) * inward
        hit = (toward >= 0.7) & (gap > 0.0) & (gap <= tolerance)
        shift = F.least(gap, F.greatest(cap_ratio * size, F.lit(cap)) + 1e-6)
        move = lambda which, on: state[which] - F.when(hit & on, shift * inward / 2).otherwise(0.0)
        grow = lambda which, axis: state[which] + F.when(hit & (t["axis"] == axis), shift * toward).otherwise(0.0)
        return F.struct(move("cx", on_x).alias("cx"), move("cy", ~on_x).alias("cy"), grow("sx", 0).alias("sx"), grow("sy", 1).alias("sy"))

    return F.aggregate(steps, F.struct(cx.alias("cx"), cy.alias("cy"), sx.alias("sx"), sy.alias("sy")), step)


def snap_yaw(rectangles: DataFrame, points: DataFrame, keys: list[str], proximity: float = 0.25, angle: float = 8.0) -> DataFrame:
    """(keys, snapped, yaw, cx, cy, length, width): rectangles near a wall and nearly in line with it are turned into line.

    ``rectangles`` (keys, cx, cy, yaw in degrees, length, width, lo_x, hi_x,
    lo_y, hi_y); extents of those that turn are measured again on their points.
    """
    near = F.least(*(f for a in "xy" for f in (F.col(f"c{a}") - F.col(f"lo_{a}"), F.col(f"hi_{a}") - F.col(f"c{a}")))) <= proximity
    apart = lambda axis: F.abs(F.pmod(F.col("yaw") - axis + 90, F.lit(180.0)) - 90)
    across = apart(90.0) < apart(0.0)
    r = rectangles.withColumns({"snapped": near & (F.least(apart(0.0), apart(90.0)) <= angle), "turned": F.when(across, -90.0).otherwise(0.0)})
    u = F.when(F.col("turned") == 0.0, F.col("x")).otherwise(-F.col("y"))
    v = F.when(F.col("turned") == 0.0, F.col("y")).otherwise(F.col("x"))
    ends = points.select(*keys, "x", "y").join(r.filter("snapped").select(*keys, "turned"), keys).groupBy(*keys).agg(F.min(u).alias("u0"), F.max(u).alias("u1"), F.min(v).alias("v0"), F.max(v).alias("v1"), F.first("turned").alias("t"))
    j = r.join(ends, keys, "left")
    mu, mv = (F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2
    own = lambda new, old: F.when(F.col("snapped") & F.col("t").isNotNull(), new).otherwise(F.col(old))
    return j.select(*keys, "snapped", own(F.col("turned"), "yaw").alias("yaw"), own(F.when(F.col("t") == 0.0, mu).otherwise(mv), "cx").alias("cx"), own(F.when(F.col("t") == 0.0, mv).otherwise(-mu), "cy").alias("cy"), own(F.col("u1") - F.col("u0"), "length").alias("length"), own(F.col("v1") - F.col("v0"), "width").alias("width"))


def with_axes(boxes: DataFrame) -> DataFrame:
    """Adds (ux, uy), the direction of each box's first side, so that pairs need no sines."""
    return boxes.withColumns({"ux": F.cos("yaw"), "uy": F.sin("yaw")})


_BOX = ("cx", "cy", "sx", "sy", "ux", "uy")


def _of_pairs(measure: Callable[..., np.ndarray], l: str, r: str) -> Column:
    """``measure`` of the boxes of each pair, in numpy over whole batches: as one expression it is more code than the JVM compiles.

    It counts as nondeterministic so that a filter on it doesn't compute it again.
    """
    udf = F.pandas_udf(lambda *c: pd.Series(measure(dict(zip(_BOX, map(np.asarray, c[:6]))), dict(zip(_BOX, map(np.asarray, c[6:]))))), "double")
    return udf.asNondeterministic()(*(F.col(f"{side}.{c}") for side in (l, r) for c in _BOX))


def _seen_from(s: dict, o: dict) -> tuple[np.ndarray, ...]:
    """Centre of box s and direction of its first side, in the frame of box o."""
    turned = lambda x, y: (x * o["ux"] + y * o["uy"], y * o["ux"] - x * o["uy"])
    return *turned(s["cx"] - o["cx"], s["cy"] - o["cy"]), *turned(s["ux"], s["uy"])


def _rectangles(l: dict, r: dict) -> np.ndarray:
    together, least = True, np.inf
    for s, o in ((l, r), (r, l)):
        u, v, c, n = _seen_from(s, o)
        a, b, x, y = s["sx"] / 2, s["sy"] / 2, o["sx"] / 2, o["sy"] / 2
        together = together & (abs(u) <= x + abs(c) * a + abs(n) * b + 1e-12) & (abs(v) <= y + abs(n) * a + abs(c) * b + 1e-12)
        for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
            du, dv = np.maximum(abs(u + c * a * i - n * b * j) - x, 0.0), np.maximum(abs(v + n * a * i + c * b * j) - y, 0.0)
            least = np.minimum(least, du * du + dv * dv)
    return np.where(together, 0.0, np.sqrt(least))


def rectangle_distance(l: str = "l", r: str = "r") -> Column:
    """Exact distance of two turned rectangles (aliases with cx, cy, sx, sy and ``with_axes``); 0 where they touch.

    No axis of either keeps rectangles apart that overlap; else the least
    distance is that of a corner of one to the other, told in its frame.
    """
    return _of_pairs(_rectangles, l, r)


def corridor_intrusion(risks: DataFrame, free: DataFrame, path: DataFrame, size: float, half_width: float = 0.6) -> DataFrame:
    """(scan_id, risk_id, in_free, distance, in_passage): risks in free cells near the path.

    ``risks`` (scan_id, risk_id, x, y), ``free`` and ``path`` (scan_id, row,
    col). Cells are found by flooring. A scan without a path counts every risk
    in a free cell.
    """
    r = risks.select("scan_id", "risk_id", spatial.cell("y", size).alias("row"), spatial.cell("x", size).alias("col"))
    inside = r.join(free.select("scan_id", "row", "col", F.lit(True).alias("in_free")), ["scan_id", "row", "col"], "left")
    way = path.select("scan_id", F.col("row").alias("prow"), F.col("col").alias("pcol"))
    d = inside.filter("in_free").join(way, "scan_id").groupBy("scan_id", "risk_id").agg((F.min(F.hypot(F.col("row") - F.col("prow"), F.col("col") - F.col("pcol"))) * size).alias("distance"))
    has = path.select("scan_id").distinct().withColumn("has_path", F.lit(True))
    j = inside.join(d, ["scan_id", "risk_id"], "left").join(has, "scan_id", "left")
    passage = F.coalesce(F.col("in_free"), F.lit(False)) & F.when(F.col("has_path"), F.col("distance") <= half_width).otherwise(F.lit(True))
    return j.select("scan_id", "risk_id", F.coalesce("in_free", F.lit(False)).alias("in_free"), "distance", passage.alias("in_passage"))


def place_in_corner(rules: DataFrame) -> DataFrame:
    """Adds cx, cy, cz, yaw to rules (size_x, size_y, size_z, corner, long_axis, bounds): two faces on two walls."""
    along_y = F.col("long_axis") == "y"
    ex, ey = F.when(along_y, F.col("size_y")).otherwise(F.col("size_x")), F.when(along_y, F.col("size_x")).otherwise(F.col("size_y"))
    end = lambda a, e: F.when(F.contains("corner", F.lit(f"+{a}")), F.col(f"hi_{a}") - e / 2).otherwise(F.col(f"lo_{a}") + e / 2)
    return rules.withColumns({"cx": end("x", ex), "cy": end("y", ey), "cz": F.col("size_z") / 2, "yaw": F.when(along_y, 90.0).otherwise(0.0)})


def place_on_wall(rules: DataFrame) -> DataFrame:
    """Adds cx, cy, cz, yaw to rules (size_*, wall_id, direction, gap, offset, bounds, anchor_x, anchor_y, anchor_ex, anchor_ey).

    The item stands against its wall, beside the anchor (its centre and its
    extents along x and y) or, without one, ``offset`` from the wall's end.
    """
    on_x = F.col("wall_id").isin(0, 2)
    ex, ey = F.when(on_x, F.col("size_x")).otherwise(F.col("size_y")), F.when(on_x, F.col("size_y")).otherwise(F.col("size_x"))

    def run(a: str, extent: Column) -> Column:
        beside = F.col(f"anchor_{a}") + F.col("direction") * ((F.col(f"anchor_e{a}") + extent) / 2 + F.col("gap"))
        from_end = F.when(F.col("direction") > 0, F.col(f"lo_{a}") + extent / 2 + F.col("offset")).otherwise(F.col(f"hi_{a}") - extent / 2 - F.col("offset"))
        return F.coalesce(beside, from_end)

    against = lambda a, extent, low: F.when(F.col("wall_id") == low, F.col(f"lo_{a}") + extent / 2).otherwise(F.col(f"hi_{a}") - extent / 2)
    return rules.withColumns({"cx": F.when(on_x, run("x", ex)).otherwise(against("x", ex, 3)), "cy": F.when(on_x, against("y", ey, 0)).otherwise(run("y", ey)), "cz": F.col("size_z") / 2, "yaw": F.when(on_x, 0.0).otherwise(90.0)})


def place_on_parent(rules: DataFrame) -> DataFrame:
    """Adds cx, cy, cz, yaw to rules (size_z, along, parent_x, parent_y, parent_z, parent_height, parent_yaw): on top of the parent, no obstacle on the floor."""
    turn = F.radians("parent_yaw")
    return rules.withColumns({"cx": F.col("parent_x") + F.col("along") * F.cos(turn), "cy": F.col("parent_y") + F.col("along") * F.sin(turn), "cz": F.col("parent_z") + F.col("parent_height") / 2 + F.col("size_z") / 2, "yaw": F.col("parent_yaw")})


def legacy_gap(l: str = "l", r: str = "r") -> Column:
    """The approximate gap of the older passage code: the least separation over axes from corners in its order, 0 without one.

    Two of the four sides it takes are diagonals, the other two are parallel,
    and it takes the least of the gaps, not the distance; kept for reports that
    were made with it. Shadows that are apart are so by the distance of their
    middles less both halves.
    """
    return _of_pairs(_legacy, l, r)


def _legacy(l: dict, r: dict) -> np.ndarray:
    least = np.inf
    for s, o in ((l, r), (r, l)):
        u, v, c, n = _seen_from(o, s)
        x, y = s["sx"], s["sy"]
        long = np.maximum(np.sqrt(x * x + y * y), 1e-12)
        for i, j in ((np.minimum(y / 1e-12, 1.0), 0.0), (y / long, x / long), (y / long, -x / long)):
            gap = abs(i * u + j * v) - (abs(i) * x + abs(j) * y) / 2 - (abs(i * c + j * n) * o["sx"] + abs(j * c - i * n) * o["sy"]) / 2
            least = np.where(gap > 1e-9, np.minimum(least, gap), least)
    return np.where(np.isinf(least), 0.0, least)


def missing_openings(points: DataFrame, room_walls: DataFrame, room: DataFrame, least: int = 30, views: int = 2) -> DataFrame:
    """(scan_id, kind, wall_id, along, width, bottom, height, views, n): openings that several views' masks see and the layout lacks.

    ``points`` (scan_id, kind, view_id, x, y, z). The wall nearest to the
    median point takes them; extents are the 5th and 95th percentiles along it.
    A door stands on the floor, a window has a sill and a lintel.
    """
    n = points.groupBy("scan_id", "kind").agg(F.countDistinct("view_id").alias("views"), F.count("*").alias("n"), F.median("x").alias("mx"), F.median("y").alias("my")).filter((F.col("views") >= views) & (F.col("n") >= least))
    turned = F.col("rotation") == 90.0
    w = room_walls.select("scan_id", "wall_id", "cx", "cy", "length", "rotation")
    away = F.when(turned, F.abs(F.col("mx") - F.col("cx"))).otherwise(F.abs(F.col("my") - F.col("cy")))
    best = n.join(w, "scan_id").groupBy("scan_id", "kind", "views", "n").agg(F.min_by(F.struct("wall_id", "cx", "cy", "length", "rotation"), F.struct(away.alias("a"), "wall_id")).alias("w"))
    along = F.when(F.col("w.rotation") == 90.0, F.col("y") - F.col("w.cy")).otherwise(F.col("x") - F.col("w.cx"))
    q = points.join(best, ["scan_id", "kind"]).groupBy("scan_id", "kind", "views", "n", "w").agg(F.percentile(along, F.array(F.lit(0.05), F.lit(0.95))).alias("a"), F.percentile("z", F.array(F.lit(0.05), F.lit(0.95))).alias("z"))
    j = q.join(room.select("scan_id", F.col("height").alias("room")), "scan_id")
    door = F.col("kind") == "door"
    bottom = F.when(door, 0.0).otherwise(F.greatest(F.col("z")[0], F.lit(0.35)))
    top = F.when(door, F.col("z")[1]).otherwise(F.least(F.col("z")[1], F.col("room") - 0.15))
    height = F.when(door, clip(top - bottom, F.lit(0.35), F.col("room"))).otherwise(clip(top - bottom, F.lit(0.35), F.least(F.lit(1.8), F.col("room") - 0.5)))
    width = clip(F.col("a")[1] - F.col("a")[0], F.lit(0.30), F.greatest("w.length", F.lit(0.30)))
    return j.select("scan_id", "kind", "w.wall_id", ((F.col("a")[0] + F.col("a")[1]) / 2).alias("along"), width.alias("width"), bottom.alias("bottom"), height.alias("height"), "views", "n")
