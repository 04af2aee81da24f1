"""The data source "ply": clouds read by byte ranges, and written with commit and abort.

``register(spark)`` makes it known; then

    spark.read.format("ply").option("properties", "red,green,blue").load(path)
    points.write.format("ply").mode("overwrite").save(path)

A folder holds files named ``<scan_id>.ply`` or ``<scan_id>_<part>.ply``. Reading
gives (scan_id, part, point_id, x, y, z, properties...); ``point_id`` counts
from 0 in each file. A binary file is cut into ranges of ``splitBytes``: records
have one width, so a task knows its records from the head alone, and reads
``batchRows`` of them at a time. An ASCII file is one range, read line by line.
A task takes ranges up to ``splitBytes``, an opened file counted as
``OPEN_BYTES``, so small files share tasks. The driver lists names and sizes
and opens nothing.

Any path that Arrow's file systems know does.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from habitrace.sources.ply import Header, ascii_rows, encode, header

SPLIT_BYTES = 64 << 20
BATCH_ROWS = 100_000
#: What opening a file counts for when ranges are dealt to tasks.
OPEN_BYTES = 1 << 16
#: Points of one written file, and of all that a task holds before it writes.
FILE_ROWS = 100_000
#: A head is looked for in this many bytes.
HEAD_BYTES = 1 << 16
#: Files that one task may write; parts are numbered task by task.
TASK_FILES = 1 << 24

_NAME = re.compile(r"([0-9]+)(?:_([0-9]+))?\.ply$")
_HEADS = "scan_id long, part long, path string, n long, error string"


@dataclass
class Range:
    """Bytes [start, end) of a file of ``size`` bytes; a record belongs where its first byte lies."""

    path: str
    start: int
    end: int
    size: int


@dataclass
class Task(InputPartition):
    """Ranges that one task reads, in order."""

    ranges: list[Range]


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written in the job's own folder."""

    files: list[str]


def named(path: str) -> tuple[int | None, int]:
    """Scan and part of a file name; without a number the scan is null."""
    found = _NAME.search(path.rsplit("/", 1)[-1])
    return (int(found[1]), int(found[2] or 0)) if found else (None, 0)


def clouds(files: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """The clouds of a folder, or the one file, by name; what lies deeper isn't read."""
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    listed = [info] if info.is_file else files.get_file_info(fs.FileSelector(root))
    return sorted((f for f in listed if f.is_file and f.path.endswith(".ply")), key=lambda f: f.path)


class PlyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options
        self.heads = options.get("heads", "false").lower() == "true"
        self.skip = options.get("errors", "raise") == "skip"

    def partitions(self) -> list[Task]:
        files, root = fs.FileSystem.from_uri(self.options["path"])
        width = int(self.options.get("splitbytes", SPLIT_BYTES))
        cut = lambda f: range(0, 1 if self.heads else max(f.size, 1), width)
        tasks, room = [], 0
        for part in (Range(f.path, at, min(at + width, max(f.size, 1)), f.size) for f in clouds(files, root) for at in cut(f)):
            cost = OPEN_BYTES + (0 if self.heads else part.end - part.start)
            if not tasks or cost > room:
                tasks.append(Task([]))
                room = width
            tasks[-1].ranges.append(part)
            room -= cost
        return tasks

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        for part in partition.ranges:
            yield from self._read(files, part)

    def _read(self, files: fs.FileSystem, partition: Range) -> Iterator[pa.RecordBatch]:
        with files.open_input_file(partition.path) as file:
            try:
                head = header(file.read(HEAD_BYTES))
                if missing := {"x", "y", "z"} - set(head.kind.names):
                    raise ValueError(f"no {', '.join(sorted(missing))}")
                if head.order and partition.size < head.body + head.count * head.kind.itemsize:
                    raise ValueError("the file ends early")
                if self.heads:
                    yield self._head(partition, head.count, None)
                    return
                for first, values in _records(file, head, partition, int(self.options.get("batchrows", BATCH_ROWS))):
                    yield self._batch(partition, first, values)
            except ValueError as why:
                if self.heads:
                    yield self._head(partition, None, str(why))
                elif not self.skip:
                    raise ValueError(f"{partition.path}: {why}") from why

    def _head(self, partition: Range, count: int | None, why: str | None) -> pa.RecordBatch:
        scan, part = named(partition.path)
        row = {"scan_id": pa.array([scan], pa.int64()), "part": pa.array([part], pa.int64()), "path": pa.array([partition.path]), "n": pa.array([count], pa.int64()), "error": pa.array([why], pa.string())}
        return pa.RecordBatch.from_pydict({n: row[n] for n in self.names})

    def _batch(self, partition: Range, first: int, values: np.ndarray) -> pa.RecordBatch:
        (scan, part), n = named(partition.path), len(values)
        own = {"scan_id": pa.array([scan] * n, pa.int64()), "part": pa.array(np.full(n, part)), "point_id": pa.array(np.arange(first, first + n))}
        value = lambda c: pa.array(values[c].astype(np.float64)) if c in values.dtype.names else pa.nulls(n, pa.float64())
        return pa.RecordBatch.from_arrays([own[c] if c in own else value(c) for c in self.names], names=self.names)


def _records(file, head: Header, partition: Range, batch: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first, records) of a range, a batch at a time."""
    if head.order is None:
        if partition.start:
            return
        file.seek(head.body)
        lines, first = io.TextIOWrapper(file, "ascii", "replace"), 0
        while first < head.count:
            values = ascii_rows(islice(lines, min(batch, head.count - first)), head.kind)
            if not len(values):
                raise ValueError("the file ends early")
            yield first, values
            first += len(values)
        return
    width = head.kind.itemsize
    number = lambda byte: min(max(-(-(byte - head.body) // width), 0), head.count)
    for first in range(number(partition.start), number(partition.end), batch):
        rows = min(batch, number(partition.end) - first)
        yield first, np.frombuffer(file.read_at(rows * width, head.body + first * width), head.kind)


class PlyWriter(DataSourceArrowWriter):
    """Files in a folder of the job's own, moved beside the others when all tasks are done.

    Rows need not be in any order: a file holds what its task has of a scan
    when it has read ``fileRows`` rows of it, or of all. Appended parts are
    numbered after those that are there.
    """

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.names = tuple(n for n in schema.names if n not in ("scan_id", "part", "point_id"))
        if missing := {"scan_id", "x", "y", "z"} - set(schema.names):
            raise ValueError(f"no {', '.join(sorted(missing))} to write")
        files, self.root = fs.FileSystem.from_uri(options["path"])
        files.create_dir(self.root)
        self.old = [f.path for f in clouds(files, self.root)]
        self.base = 0 if overwrite else max((named(p)[1] for p in self.old), default=-1) + 1
        self.own = f"{self.root}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        context, most = TaskContext.get(), int(self.options.get("filerows", FILE_ROWS))
        folder = f"{self.own}/{context.taskAttemptId()}"
        files.create_dir(folder)
        held: dict[int, list[np.ndarray]] = {}
        done: list[str] = []

        def flush(scan: int) -> None:
            values = np.concatenate(held.pop(scan))
            for at in range(0, len(values), most):
                if len(done) >= TASK_FILES:
                    raise ValueError("too many files in one task: repartition, or write larger files")
                path = f"{folder}/{scan}_{self.base + context.partitionId() * TASK_FILES + len(done)}.ply"
                with files.open_output_stream(path) as out:
                    out.write(encode(values[at : at + most], self.names))
                done.append(path)

        for batch in iterator:
            column = batch.column("scan_id")
            if column.null_count:
                raise ValueError("a point without a scan can't be written")
            scans = column.to_numpy()
            values = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in self.names], axis=1)
            edges = np.flatnonzero(np.diff(scans)) + 1
            for scan, rows in zip(scans[np.r_[0, edges]] if len(scans) else (), np.split(values, edges)):
                held.setdefault(int(scan), []).append(rows)
                if sum(map(len, held[int(scan)])) >= most:
                    flush(int(scan))
            if sum(len(r) for rows in held.values() for r in rows) >= most:
                for scan in list(held):
                    flush(scan)
        for scan in list(held):
            flush(scan)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        fresh = [(p, f"{self.root}/{p.rsplit('/', 1)[-1]}") for m in messages if m for p in m.files]
        for source, target in fresh:
            files.move(source, target)
        for path in set(self.old) - {t for _, t in fresh} if self.overwrite else ():
            files.delete_file(path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        if files.get_file_info(self.own).type == fs.FileType.Directory:
            files.delete_dir(self.own)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        if self.options.get("heads", "false").lower() == "true":
            return _HEADS
        extra = [p.strip() for p in self.options.get("properties", "").split(",") if p.strip()]
        return "scan_id long, part long, point_id long, " + ", ".join(f"`{c}` double" for c in ("x", "y", "z", *extra))

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def write_clouds(points: DataFrame, path: str, extra: tuple[str, ...] = (), rows: int = FILE_ROWS, mode: str = "overwrite") -> None:
    """Points in order of scan and id, in files of at most ``rows``; a large scan is spread over tasks."""
    register(points.sparkSession)
    laid = points.select("scan_id", "point_id", "x", "y", "z", *extra).repartitionByRange("scan_id", "point_id").sortWithinPartitions("scan_id", "point_id")
    laid.write.format("ply").option("fileRows", rows).mode(mode).save(path)


def read_clouds(spark: SparkSession, path: str, extra: tuple[str, ...] = (), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(scan_id, point_id, x, y, z, extra...): points numbered through a scan's parts.

    The points of the parts before are added up from the heads of the files.
    """
    register(spark)
    heads = spark.read.format("ply").option("heads", "true").load(path)
    before = Window.partitionBy("scan_id").orderBy("part", "path").rowsBetween(Window.unboundedPreceding, -1)
    firsts = heads.select("scan_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    found = spark.read.format("ply").option("properties", ",".join(extra)).option("splitBytes", split_bytes).load(path)
    return found.join(firsts, ["scan_id", "part"]).select("scan_id", (F.col("point_id") + F.col("first")).alias("point_id"), "x", "y", "z", *extra)
