"""Streaming forms: windows with a watermark, deduplication, status, incremental fusion.

Each function takes a streaming DataFrame of events with ``ts`` as TIMESTAMP
and returns the transformed stream. ``drain`` runs one until its source is used
up; its rows stay on the cluster: every micro-batch is one folder of a Parquet
table in the shared folder, written again if the batch is, and the latest row
of a key is what counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitrace.operators import spatial
from habitrace.session import new_path

STAGES = {"signup": 5, "view": 15, "click": 75, "error": 88, "purchase": 100}


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of one table, a file or a folder: a pattern that only its path fits takes either."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events; watermarks need TIMESTAMP, so ``ts`` is cast (session zone UTC)."""
    return file_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums of each hour and type; hours close when the watermark passes them."""
    hour = F.window("ts", "1 hour")
    counts = events.withWatermark("ts", late).groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first event of each user and type within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def status(events: DataFrame) -> DataFrame:
    """Progress never goes back: the furthest stage seen per scan and its last time."""
    stage = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))[F.col("event_type")]
    return events.groupBy("user_id").agg(F.max(stage).alias("progress"), F.max("ts").alias("at"), F.count("*").alias("updates"))


def drain(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str] | None = None, each: Callable[[DataFrame], DataFrame] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """All rows that the stream gives until its source is used up; with ``keys`` the latest of each key.

    ``each`` is applied to a micro-batch before it is written; the stream is
    started with ``settings``, which the session doesn't keep.
    """
    path = new_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    if not keys:
        return rows.drop("batch")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")


def voxel_parts(points: DataFrame, size: float) -> DataFrame:
    """Partial sums of a block's points by scan, voxel and frame, which later blocks are merged with."""
    cells = [spatial.cell(c, size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy("scan_id", *cells, "frame_id", "block_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "xyz"))


def fused(parts: DataFrame, frames: int = 3, blocks: int = 2) -> DataFrame:
    """(scan_id, voxel, n, x, y, z): merged partial sums of voxels that enough frames and blocks have seen."""
    cells = ["scan_id", "vx", "vy", "vz"]
    whole = parts.groupBy(*cells).agg(F.countDistinct("frame_id").alias("frames"), F.countDistinct("block_id").alias("blocks"), F.sum("n").alias("n"), *((F.sum(f"s{c}") / F.sum("n")).alias(c) for c in "xyz"))
    return whole.filter((F.col("frames") >= frames) & (F.col("blocks") >= blocks)).drop("frames", "blocks")
