"""Components, clusters, tracks and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from habitrace.operators import graph, grid, spatial
from habitrace.plans.define import q6, query, r6
from habitrace.session import settled
from habitrace.sources.driver_tables import FRAMES_SQL, ROOM_POINTS_SQL, frames, room_points

_E = f"{ROOM_POINTS_SQL}, e as (select a.scan_id, a.point_id as a, b.point_id as b from points a join points b on a.scan_id = b.scan_id and a.point_id <> b.point_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.07)"


def _near(spark, sf_dir):
    return spatial.radius_pairs(room_points(spark, sf_dir), 0.07)


@query(f"with recursive {_E}, r as (select scan_id, point_id as node, point_id as lab from points union select r.scan_id, e.b, r.lab from r join e on e.scan_id = r.scan_id and e.a = r.node) select scan_id, node as point_id, min(lab) as component from r group by 1, 2")
def connected_components(spark, sf_dir):
    """Radius components of each scan's points, named by the least point."""
    nodes = room_points(spark, sf_dir).select(F.col("scan_id").alias("scope"), F.col("point_id").alias("node"))
    found = graph.components(nodes, _near(spark, sf_dir).select(F.col("scan_id").alias("scope"), "a", "b"))
    return found.select(F.col("scope").alias("scan_id"), F.col("node").alias("point_id"), "component")


@query(
    f"""with recursive {_E}, c as (select scan_id, a as node from e group by 1, 2 having count(*) + 1 >= 4), ce as (select e.* from e join c x on x.scan_id = e.scan_id and x.node = e.a join c y on y.scan_id = e.scan_id and y.node = e.b),
r as (select scan_id, node, node as lab from c union select r.scan_id, ce.b, r.lab from r join ce on ce.scan_id = r.scan_id and ce.a = r.node), k as (select scan_id, node, min(lab) as cluster from r group by 1, 2),
b as (select e.scan_id, e.a as node, min(k.cluster) as beside from e join k on k.scan_id = e.scan_id and k.node = e.b group by 1, 2)
select p.scan_id, p.point_id, k.cluster is not null as core, coalesce(k.cluster, b.beside) as cluster from points p left join k on k.scan_id = p.scan_id and k.node = p.point_id left join b on b.scan_id = p.scan_id and b.node = p.point_id"""
)
def dbscan_clusters(spark, sf_dir):
    return graph.dbscan(room_points(spark, sf_dir), _near(spark, sf_dir), 4)


_TRACK = f"{FRAMES_SQL}, s as (select distinct kind || '/' || scan_id as node, scan_id, view_id from frames where value > 40), n as (select node, count(*) as n from s group by 1), e as (select a.scan_id, a.node as a, b.node as b from s a join s b on a.scan_id = b.scan_id and a.view_id = b.view_id and a.node <> b.node join n x on x.node = a.node join n y on y.node = b.node group by 1, 2, 3 having count(*) / least(any_value(x.n), any_value(y.n)) >= 0.5)"


@query(f"with recursive {_TRACK}, r as (select distinct scan_id, node, node as lab from s union select r.scan_id, e.b, r.lab from r join e on e.scan_id = r.scan_id and e.a = r.node) select scan_id, node, min(lab) as track from r group by 1, 2")
def track_association(spark, sf_dir):
    """Observations of a scan that share at least half of the smaller one's views belong to one track."""
    s = frames(spark, sf_dir).filter("value > 40").select(F.concat_ws("/", "kind", F.col("scan_id").cast("string")).alias("node"), "scan_id", "view_id").distinct()
    n = s.groupBy("scan_id", "node").agg(F.count("*").alias("n"))
    both = s.alias("p").join(s.alias("q"), ["scan_id", "view_id"]).filter("p.node < q.node").groupBy("scan_id", F.col("p.node").alias("a"), F.col("q.node").alias("b")).agg(F.count("*").alias("k"))
    sized = both.join(n.select("scan_id", F.col("node").alias("a"), F.col("n").alias("na")), ["scan_id", "a"]).join(n.select("scan_id", F.col("node").alias("b"), F.col("n").alias("nb")), ["scan_id", "b"])
    edges = sized.filter(F.col("k") / F.least("na", "nb") >= 0.5).select(F.col("scan_id").alias("scope"), "a", "b")
    found = graph.components(s.select(F.col("scan_id").alias("scope"), "node"), edges)
    return found.select(F.col("scope").alias("scan_id"), "node", F.col("component").alias("track"))


#: A grid per scan: cells of 0.06 over the points' rectangle and one cell around, blocked where points of labels 0 to 2 stand.
_G = f"""{ROOM_POINTS_SQL}, cl as (select scan_id, floor(y / 0.06)::bigint as row, floor(x / 0.06)::bigint as col, label from points), blocked as (select distinct scan_id, row, col from cl where label < 3),
bb as (select scan_id, min(row) - 1 as r0, max(row) + 1 as r1, min(col) - 1 as c0, max(col) + 1 as c1 from cl group by 1),
free as (select b.scan_id, r.row, c.col from bb b, lateral (select unnest(range(r0, r1 + 1)) as row) r, lateral (select unnest(range(c0, c1 + 1)) as col) c where not exists (select 1 from blocked k where k.scan_id = b.scan_id and k.row = r.row and k.col = c.col))"""


def _grid(spark, sf_dir):
    return grid.cells(room_points(spark, sf_dir), 0.06, F.col("label") < 3)


def _free(spark, sf_dir):
    return settled(_grid(spark, sf_dir).filter("not blocked").select("scan_id", "row", "col"))


def _seeds(free):
    """The free cell nearest to the middle of the scan's coordinates."""
    return grid.nearest_free(free, free.select("scan_id").distinct().select("scan_id", F.lit(0).alias("srow"), F.lit(0).alias("scol")))


_SEED = "seed as (select scan_id, row, col from (select *, row_number() over (partition by scan_id order by greatest(abs(row), abs(col)), row * row + col * col, row, col) as k from free) where k = 1)"


@query(f"with {_G}, {_SEED} select * from seed")
def nearest_free_cell(spark, sf_dir):
    return _seeds(_free(spark, sf_dir))


_WALK = "w(scan_id, row, col, d) as (select scan_id, row, col, 0 from seed union select w.scan_id, f.row, f.col, w.d + 1 from w join free f on f.scan_id = w.scan_id and {near} where w.d < 60)"


@query(f"with recursive {_G}, {_SEED}, {_WALK.format(near='greatest(abs(f.row - w.row), abs(f.col - w.col)) = 1')} select scan_id, row, col, min(d)::double as dist from w group by 1, 2, 3")
def grid_bfs(spark, sf_dir):
    """Steps over 8 neighbours from the cell nearest to the middle."""
    free = _free(spark, sf_dir)
    return graph.grid_distances(free, _seeds(free), [(r, c, 1.0) for r, c, _ in graph.EIGHT])


@query(f"with recursive {_G}, {_SEED}, {_WALK.format(near='abs(f.row - w.row) + abs(f.col - w.col) = 1')} select distinct scan_id, row, col from w")
def flood_fill(spark, sf_dir):
    free = _free(spark, sf_dir)
    return graph.grid_distances(free, _seeds(free), graph.FOUR).select("scan_id", "row", "col")


@query(f"with {_G} select f.scan_id, f.row, f.col, {q6('min(sqrt(pow(f.row - b.row, 2) + pow(f.col - b.col, 2)))')} as clearance from free f join blocked b using (scan_id) group by 1, 2, 3")
def distance_transform(spark, sf_dir):
    """Distance of every free cell to the nearest blocked one."""
    return grid.distance_transform(_grid(spark, sf_dir)).filter("not blocked").select("scan_id", "row", "col", r6("clearance").alias("clearance"))


@query()
def clearance_route(spark, sf_dir):
    """Cheapest distances in metres where steps near obstacles cost more."""
    cells = settled(_grid(spark, sf_dir))
    seeds = _seeds(cells.filter("not blocked"))
    return grid.route_costs(cells, seeds, 0.06).withColumn("dist", r6("dist"))


@query(
    f"""with {_G}, f as (select scan_id, count(*) as free_cells from free group by 1), n as (select scan_id, (r1 - r0 + 1) * (c1 - c0 + 1) as cells from bb)
select n.scan_id, n.cells, coalesce(f.free_cells, 0) as free_cells, {q6('coalesce(f.free_cells, 0) * 0.06 * 0.06')} as free_area, {q6('100.0 * coalesce(f.free_cells, 0) / n.cells')} as free_percent from n left join f using (scan_id)"""
)
def free_area(spark, sf_dir):
    """Free floor of each scan: cells, area and share of the bounding rectangle."""
    per = _grid(spark, sf_dir).groupBy("scan_id").agg(F.count("*").alias("cells"), F.count_if(~F.col("blocked")).alias("free_cells"))
    return per.select("scan_id", "cells", "free_cells", r6(F.col("free_cells") * 0.06 * 0.06).alias("free_area"), r6(100.0 * F.col("free_cells") / F.col("cells")).alias("free_percent"))
