"""Gaussian splats for viewers: parameters as the web formats hold them, and records of 32 bytes.

A splat has x, y, z, scale_0..2, opacity, rot_0..3 (w, x, y, z) and f_dc_0..2.
Everything is columns; only the packing of finished numbers into bytes runs over
Arrow batches, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitrace.session import new_path

#: Least scale, least distance of an opacity from 0 and 1, least norm of a rotation.
LEAST_SCALE, LEAST_OPACITY, LEAST_NORM = 1e-12, 1e-6, 1e-12
CENTRE, SCALE, TURN, COLOUR = ("x", "y", "z"), tuple(f"scale_{k}" for k in range(3)), tuple(f"rot_{k}" for k in range(4)), tuple(f"f_dc_{k}" for k in range(3))
NUMBERS = (*CENTRE, *SCALE, "opacity", *TURN, *COLOUR)
#: Fixed layout of a record: six floats, then colour, opacity and rotation as bytes, the rotation in the order w, x, y, z.
RECORD = np.dtype([("place", "<f4", 3), ("scale", "<f4", 3), ("rgba", "u1", 4), ("turn", "u1", 4)])
BYTES = ("red", "green", "blue", "alpha", "turn_w", "turn_x", "turn_y", "turn_z")


def whole(splats: DataFrame) -> DataFrame:
    """``splats`` whose numbers are all there and finite; a training that went wrong leaves others."""
    return splats.filter(F.forall(F.array(*(F.col(c).cast("double") for c in NUMBERS)), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))


def web_parameters(splats: DataFrame) -> DataFrame:
    """``splats`` with scales as logarithms, opacity as log odds and rotations in the order x, y, z, w.

    Scales below 1e-12 count as that, opacities are held 1e-6 from 0 and 1.
    Count, places, colours and all other columns stay as they are. Nulls stay
    null.
    """
    o = F.least(F.greatest(F.col("opacity").cast("double"), F.lit(LEAST_OPACITY)), F.lit(1 - LEAST_OPACITY))
    held = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c).cast("double"), F.lit(LEAST_SCALE)))
    order = {"rot_0": "rot_1", "rot_1": "rot_2", "rot_2": "rot_3", "rot_3": "rot_0"}
    return splats.withColumns({c: F.log(held(c)) for c in SCALE} | {"opacity": F.when(F.col("opacity").isNotNull(), F.log(o / (1 - o)))} | {c: F.col(d) for c, d in order.items()})


def _byte(value: Column) -> Column:
    """The whole part of ``value``, from 0 to 255."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int")


def record_fields(splats: DataFrame) -> DataFrame:
    """``splats`` with the eight byte values of their records beside places and scales.

    Colours and opacity are shares of 255, the unit rotation is 128 a unit
    around 128; what lies outside goes to 0 or 255. A rotation of zeros has all bytes 128.
    """
    size = F.greatest(F.sqrt(sum((F.col(c).cast("double") ** 2 for c in TURN[1:]), F.col("rot_0").cast("double") ** 2)), F.lit(LEAST_NORM))
    values = [F.col(c).cast("double") * 255 for c in (*COLOUR, "opacity")] + [F.col(c).cast("double") / size * 128 + 128 for c in TURN]
    return splats.withColumns({name: _byte(v) for name, v in zip(BYTES, values)})


def records(splats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, record): a splat's 32 bytes.

    ``splats`` must be ``whole``: rows with a missing or non-finite number are
    left out, as a viewer can't show them.
    """
    fields = record_fields(whole(splats)).select(*keys, F.array(*(F.col(c).cast("float") for c in (*CENTRE, *SCALE))).alias("_f"), F.array(*BYTES).alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floats, small = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for k in (-2, -1))
            rows = np.empty(len(batch), RECORD)
            rows["place"], rows["scale"], rows["rgba"], rows["turn"] = floats[:, :3], floats[:, 3:], small[:, :4], small[:, 4:]
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(RECORD.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], packed], names=[*keys, "record"])

    kinds = ", ".join(f"`{k}` {dict(fields.dtypes)[k]}" for k in keys)
    return fields.mapInArrow(run, f"{kinds}, record binary")


def write_splats(splats: DataFrame, path: str, part: int = 100_000) -> None:
    """Writes (scan_id, part, n, content) files under ``path``: a scan's records by splat_id, ``part`` at most in a row.

    ``splats`` (scan_id, splat_id, numbers...), splat_id counting from 0 or more
    in each scan; a scan's parts, one after the other, are its web file. Rows
    without a scan or splat_id are left out.
    """
    packed = records(splats.filter("scan_id is not null and splat_id is not null"), ["scan_id", "splat_id"])
    ordered = packed.groupBy("scan_id", F.floor(F.col("splat_id") / part).alias("part")).agg(F.sort_array(F.collect_list(F.struct("splat_id", "record"))).alias("rows"))
    joined = F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["record"])), ""))
    ordered.select("scan_id", "part", F.size("rows").cast("long").alias("n"), joined.alias("content")).write.parquet(path)


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, place, x, y, z, scale_0..2, byte values): the records of ``write_splats``, numbered through a scan's parts."""
    files = spark.read.parquet(path)
    before = files.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
    first = F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("part")), F.lit(0).cast("long"), lambda n, p: n + p["n"])
    placed = files.join(before, "scan_id").select("scan_id", first.alias("first"), "content")
    names = ["scan_id", "place", *CENTRE, *SCALE, *BYTES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan, start, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = np.frombuffer(content, RECORD)
                columns = [np.full(len(rows), scan), start + np.arange(len(rows)), *rows["place"].T, *rows["scale"].T, *rows["rgba"].T.astype(np.int32), *rows["turn"].T.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    kinds = ["long", "long", *["float"] * 6, *["int"] * 8]
    return placed.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def round_trip(splats: DataFrame, part: int = 100_000) -> DataFrame:
    """What a viewer reads after ``splats`` were written to the shared folder."""
    path = new_path(splats.sparkSession, "splats")
    write_splats(splats, path, part)
    return read_splats(splats.sparkSession, path)
