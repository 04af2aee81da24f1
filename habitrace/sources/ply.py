"""PLY point clouds: any scalar vertex properties, binary little-endian or ASCII.

Files are read through Spark's ``binaryFile`` source, so any file system does;
one file is one scan's cloud and is decoded in one Arrow call. Writing gives
(scan_id, part, content) rows, each a complete file of at most ``rows`` points.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: PLY scalar types and their NumPy forms.
TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


#: The forms of a PLY body and their byte order.
FORMS = {"ascii": None, "binary_little_endian": "<", "binary_big_endian": ">"}


class Header(NamedTuple):
    """What a file's head says of its vertices: byte order (None in ASCII), number, record, where the body begins."""

    order: str | None
    count: int
    kind: np.dtype
    body: int


def header(content: bytes) -> Header:
    """The head of a file, of which ``content`` holds at least that; what can't be read raises ValueError."""
    found = re.search(rb"end_header\r?\n", content)
    lines = content[: found.start()].decode("ascii", "replace").splitlines() if found else []
    if not lines or lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    form, count, fields, element = "binary_little_endian", 0, [], None
    for words in map(str.split, lines):
        if words[:1] == ["format"] and len(words) > 1:
            form = words[1]
        elif words[:1] == ["element"] and len(words) == 3:
            element = words[1]
            if element == "vertex":
                count = int(words[2])
            elif not fields and int(words[2]):
                raise ValueError(f"{element} before the vertices")
        elif element == "vertex" and words[:1] == ["property"]:
            if len(words) != 3 or words[1] not in TYPES:
                raise ValueError(f"unknown property type {words[1] if len(words) > 1 else ''}")
            fields.append((words[2], TYPES[words[1]]))
    if form not in FORMS:
        raise ValueError(f"unknown format {form}")
    if not count:
        raise ValueError("the cloud is empty")
    kind = np.dtype(fields)
    return Header(FORMS[form], count, kind.newbyteorder(">") if FORMS[form] == ">" else kind, found.end())


def ascii_rows(lines: Iterable[str], kind: np.dtype) -> np.ndarray:
    """Vertices of ASCII lines; a line with too few or odd values raises ValueError."""
    rows = [tuple(map(float, line.split()[: len(kind)])) for line in lines]
    if any(len(r) < len(kind) for r in rows):
        raise ValueError("the file ends early")
    return np.array(rows, kind)


def decode(content: bytes) -> np.ndarray:
    """Vertices as a structured array, all scalar properties; what can't be read raises ValueError."""
    order, count, kind, body = header(content)
    rest = content[body:]
    if order is None:
        found = ascii_rows(rest.decode("ascii", "replace").splitlines()[:count], kind)
        if len(found) < count:
            raise ValueError("the file ends early")
        return found
    if len(rest) < count * kind.itemsize:
        raise ValueError("the file ends early")
    return np.frombuffer(rest, kind, count)


def encode(values: np.ndarray, names: tuple[str, ...] = ("x", "y", "z")) -> bytes:
    """A binary file of float properties: three coordinates, or six with normals or colours."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(values)}\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    return head.encode() + np.ascontiguousarray(values, "<f4").tobytes()


def _points_of(files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(scan_id, point_id, x, y, z, extra..., error) from (scan_id, first, content).

    A file that can't be read, or is empty, gives one row that says why and has
    no point. Extra properties that a file lacks are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["scan_id", "point_id", "x", "y", "z", *extra, "error"]
        for batch in batches:
            for scan, first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    v = decode(content or b"")
                    if missing := {"x", "y", "z"} - set(v.dtype.names):
                        raise ValueError(f"no {', '.join(sorted(missing))}")
                except ValueError as why:
                    yield pa.RecordBatch.from_arrays([pa.array([scan], pa.int64()), pa.array([None], pa.int64()), *([pa.array([None], pa.float64())] * (3 + len(extra))), pa.array([str(why)], pa.string())], names=names)
                    continue
                n = len(v)
                values = [pa.array(v[c].astype(np.float64)) if c in v.dtype.names else pa.nulls(n, pa.float64()) for c in ("x", "y", "z", *extra)]
                yield pa.RecordBatch.from_arrays([pa.array([scan] * n, pa.int64()), pa.array(np.arange(first or 0, (first or 0) + n, dtype=np.int64)), *values, pa.nulls(n, pa.string())], names=names)

    kinds = ", ".join(f"{c} double" for c in ("x", "y", "z", *extra))
    return files.mapInArrow(run, f"scan_id long, point_id long, {kinds}, error string")


def readable(points: DataFrame) -> DataFrame:
    """The points of files that could be read; a file that couldn't raises an error that names its scan."""
    told = F.concat(F.lit("scan "), F.coalesce(F.col("scan_id").cast("string"), F.lit("?")), F.lit(": "), F.col("error"))
    checked = F.when(F.col("error").isNotNull(), F.raise_error(told).cast("bigint")).otherwise(F.col("scan_id"))
    return points.withColumn("scan_id", checked).drop("error")


def _sizes(files: DataFrame) -> DataFrame:
    """(path, n) from (path, content): points per file, none in an unreadable one."""

    def size(content: bytes) -> int:
        try:
            return len(decode(content))
        except ValueError:
            return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([size(content or b"")], pa.int64())], names=["path", "n"])

    return files.mapInArrow(run, "path string, n long")


def _first(*order: str) -> Column:
    """The points in a scan's parts before."""
    before = Window.partitionBy("scan_id").orderBy(*(F.asc_nulls_first(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint")


def read_ply(spark: SparkSession, path: str, extra: tuple[str, ...] = (), errors: str = "raise") -> DataFrame:
    """Clouds named ``<scan_id>.ply`` (or ``<scan_id>_<part>.ply``) under ``path``; points are numbered through a scan's parts.

    Returns (scan_id, point_id, x, y, z, extra...). A file that is empty or
    can't be read is an error that names its scan; with ``errors`` "rows" it is
    a row that says why in a column ``error``, with "skip" it is passed over.
    """
    if errors not in ("raise", "rows", "skip"):
        raise ValueError("errors must be raise, rows or skip")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path)
    name = lambda k: F.regexp_extract("path", r"([0-9]+)(?:_([0-9]+))?\.ply$", k).try_cast("bigint")
    sizes = _sizes(files.select("path", "content")).select("path", name(1).alias("scan_id"), name(2).alias("part"), "n")
    firsts = sizes.select("path", "scan_id", _first("part", "path").alias("first"))
    found = _points_of(files.select("path", "content").join(firsts, "path").select("scan_id", "first", "content"), extra)
    return {"raise": readable, "rows": lambda f: f, "skip": lambda f: f.filter("error is null").drop("error")}[errors](found)


def encoded(points: DataFrame, rows: int = 100_000, extra: tuple[str, ...] = ()) -> DataFrame:
    """(scan_id, part, first, content): files of at most about ``rows`` points, split by point id.

    ``first`` counts the points in the scan's parts before; ``extra`` columns
    (normals, colours) are written as float properties too.
    """
    names = ("x", "y", "z", *extra)

    def one(table: pa.Table) -> pa.Table:
        t = table.sort_by("point_id")
        values = np.stack([t.column(c).to_numpy() for c in names], axis=1)
        return pa.table({"scan_id": t.column("scan_id")[:1], "part": t.column("part")[:1], "content": pa.array([encode(values, names)], pa.binary())})

    parted = points.withColumn("part", F.floor(F.col("point_id") / rows))
    files = parted.select("scan_id", "part", "point_id", *names).groupBy("scan_id", "part").applyInArrow(one, "scan_id long, part long, content binary").alias("f")
    counts = parted.groupBy("scan_id", "part").agg(F.count("*").alias("n"))
    firsts = counts.select("scan_id", "part", _first("part").alias("first")).alias("c")
    same = F.col("f.scan_id").eqNullSafe(F.col("c.scan_id")) & F.col("f.part").eqNullSafe(F.col("c.part"))
    return files.join(firsts, same).select("f.scan_id", "f.part", "c.first", "f.content")


def decoded(files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The points of ``encoded`` rows, numbered through a scan's parts; a broken file is an error."""
    return readable(_points_of(files.select("scan_id", "first", "content"), extra))
