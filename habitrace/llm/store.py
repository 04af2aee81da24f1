"""Where the operators of this subpackage read tables and keep intermediate results.

Intermediate results live in the folder that the cluster names in
``spark.checkpoint.dir``; only a local session (tests, a laptop) where that is
unset gets a temporary folder, a cluster without it is an error. Nothing here
uses executor-local storage, so a lost executor costs a recomputation and never
data.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes sure that ``checkpoint()`` can use it."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="habitrace-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` computed once, its lineage cut by a reliable checkpoint."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    return f"{shared_dir(spark)}/habitrace-{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` as a Parquet table (zstd) in the shared folder, read again."""
    path = new_path(frame.sparkSession, label)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
