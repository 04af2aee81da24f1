"""The driver's tables, read in the roles that the operators expect.

``events`` stands for detections and frames (user = scan or track, type = label
or view kind, value = weight or measure), the first three components of
``embeddings`` for points, ``lineitem`` for measured objects of a scan
(``orders``), ``customer`` for projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scans that hold all vectors of a table: they grow with it.
SCANS = 5

#: Vectors of one room: a room's size is bounded, the number of rooms grows with the table.
SCAN_SIZE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scan() -> Column:
    return F.pmod("vec_id", F.lit(SCANS))


def _room() -> Column:
    return F.floor(F.col("vec_id") / SCAN_SIZE)


_SCAN_SQL, _ROOM_SQL = f"vec_id % {SCANS}", f"vec_id // {SCAN_SIZE}"


def _points(spark: SparkSession, sf_dir: str, scan: Column) -> DataFrame:
    axis = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(scan.alias("scan_id"), F.col("vec_id").alias("point_id"), axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"), F.col("label").cast("bigint").alias("label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(scan_id, point_id, x, y, z, label)."""
    return _points(spark, sf_dir, _scan())


def room_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns by rooms."""
    return _points(spark, sf_dir, _room())


def _points_sql(scan: str) -> str:
    return f"points as (select {scan} as scan_id, vec_id as point_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label::bigint as label from embeddings)"


POINTS_SQL, ROOM_POINTS_SQL = _points_sql(_SCAN_SQL), _points_sql(_ROOM_SQL)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(scan_id, frame_id, ts, kind, value, view_id): one per event."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("frame_id"), "ts", F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("view_id"))


FRAMES_SQL = "frames as (select user_id as scan_id, event_id as frame_id, ts, event_type as kind, value, cast(json_extract_string(props, '$.k') as bigint) as view_id from events)"


def _boxes(spark: SparkSession, sf_dir: str, scan: Column) -> DataFrame:
    axis = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings")
    side = lambda i: F.abs(axis(i)) + 0.05
    return rows.select(
        scan.alias("scan_id"), F.col("vec_id").alias("box_id"), F.col("label").cast("bigint").alias("label"),
        *((axis(i) * 10).alias(n) for i, n in enumerate(("cx", "cy", "cz"))), *((side(i + 3) * 2).alias(n) for i, n in enumerate(("sx", "sy", "sz"))), (axis(6) * 3).alias("yaw"), (F.abs(axis(7)) + 0.1).alias("score"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes(scan_id, box_id, label, cx, cy, cz, sx, sy, sz, yaw): one per vector."""
    return _boxes(spark, sf_dir, _scan())


def room_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns by rooms."""
    return _boxes(spark, sf_dir, _room())


def _boxes_sql(scan: str) -> str:
    return (
        f"boxes as (select {scan} as scan_id, vec_id as box_id, label::bigint as label, "
        + ", ".join(f"embedding[{i + 1}]::double * 10 as {n}" for i, n in enumerate(("cx", "cy", "cz")))
        + ", "
        + ", ".join(f"(abs(embedding[{i + 4}]::double) + 0.05) * 2 as {n}" for i, n in enumerate(("sx", "sy", "sz")))
        + ", embedding[7]::double * 3 as yaw, abs(embedding[8]::double) + 0.1 as score from embeddings)"
    )


BOXES_SQL, ROOM_BOXES_SQL = _boxes_sql(_SCAN_SQL), _boxes_sql(_ROOM_SQL)
