"""A keyed table that micro-batches are merged into, any number of times each.

Rows lie in buckets by a hash of their key. A batch rewrites the buckets it
touches, whole, under its own number; a manifest, one small file a batch, then
says which batch holds each bucket. The manifest is written last: a batch that
failed before is written again, and one that did not is passed over, so a
replay leaves the table as it was and a reader never sees half a batch.
"""

from __future__ import annotations

from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """The latest row of each key: the greatest by ``order``, of equal ones the greatest by all columns.

    Batches are numbered upward, as ``foreachBatch`` numbers them. Null keys
    are one key, null order values the least. One writer at a time. ``buckets``
    bounds what one task merges and the size of the manifest.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _manifest(self) -> tuple[int, dict[int, int]]:
        """The last batch that was committed, and the batch that holds each bucket (at most ``buckets`` entries)."""
        files, root = fs.FileSystem.from_uri(self.path)
        listed = files.get_file_info(fs.FileSelector(f"{root}/manifest", allow_not_found=True, recursive=True))
        done = [int(f.path.rsplit("batch=", 1)[1].split("/")[0]) for f in listed if f.base_name == "_SUCCESS"]
        if not done:
            return -1, {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/batch={max(done)}").collect()
        return max(done), {r.bucket: r.batch for r in rows}

    def _held(self, manifest: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/rows/batch={batch}/bucket={bucket}" for bucket, batch in sorted(manifest.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, rows: DataFrame, number: int) -> bool:
        """Whether batch ``number`` was merged; False if the table has it already."""
        last, manifest = self._manifest()
        if number <= last:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = rows.withColumn("bucket", bucket)
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        if touched:
            held = self._held({b: manifest[b] for b in touched if b in manifest})
            both = fresh if held is None else fresh.unionByName(held.withColumn("bucket", bucket), allowMissingColumns=True)
            cols = [c for c in both.columns if c != "bucket"]
            latest = F.max_by(F.struct(*cols), F.struct(*self.order, *cols)).alias("_r")
            merged = both.groupBy("bucket", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).agg(latest).select("bucket", "_r.*")
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
        now = manifest | dict.fromkeys(touched, number)
        said = self.spark.createDataFrame(sorted(now.items()), "bucket int, batch long")
        said.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")
        return True

    def read(self) -> DataFrame | None:
        """The table as the last committed batch left it; None before the first row."""
        return self._held(self._manifest()[1])

    def vacuum(self) -> int:
        """Removes buckets that no reader of the last manifest needs, and earlier manifests; how many folders went."""
        last, manifest = self._manifest()
        files, root = fs.FileSystem.from_uri(self.path)
        below = lambda folder: files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        old = [f.path for f in below(f"{root}/manifest") if int(f.base_name.split("=")[1]) < last]
        written = reduce(list.__add__, (below(f.path) for f in below(f"{root}/rows") if int(f.base_name.split("=")[1]) <= last), [])
        for f in written:
            if f.base_name.startswith("bucket=") and manifest.get(int(f.base_name.split("=")[1])) != int(f.path.rsplit("batch=", 1)[1].split("/")[0]):
                old.append(f.path)
        for path in old:
            files.delete_dir(path)
        return len(old)

    def start(self, stream: DataFrame, checkpoint: str):
        """Merges a stream; the query that runs until its source is used up."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
