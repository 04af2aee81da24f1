"""The data source "ply": ranges of large files, all forms, commit and abort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitrace.sources import ply, ply_source


def test_one_large_file_is_many_tasks(spark, tmp_path):
    n = 2_000_000
    (tmp_path / "7.ply").write_bytes(ply.encode(np.arange(3.0 * n).reshape(n, 3) % 1000))
    ply_source.register(spark)
    found = spark.read.format("ply").option("splitBytes", 1_000_003).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 25
    told = found.withColumn("task", F.spark_partition_id())
    got = told.agg(F.count("*"), F.count_distinct("point_id"), F.min("point_id"), F.max("point_id"), F.sum((F.col("x") != F.col("point_id") * 3 % 1000).cast("int")), F.count_distinct("task")).first()
    assert tuple(got) == (n, n, 0, n - 1, 0, 25)


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_forms_and_ranges(spark, tmp_path, width):
    """Little and big endian, ASCII, doubles and integers, carriage returns, elements after the vertices; every range width gives all points once."""
    head = "ply\nformat {} 1.0\nelement vertex 5\nproperty double x\nproperty uchar red\nproperty float y\nproperty short z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    kind = [("x", "f8"), ("red", "u1"), ("y", "f4"), ("z", "i2")]
    values = np.array([(i + 0.5, 200 + i, -i, i * 7) for i in range(5)], kind)
    little = values.astype([(n, "<" + t if t != "u1" else t) for n, t in kind]).tobytes()
    big = values.astype([(n, ">" + t if t != "u1" else t) for n, t in kind]).tobytes()
    (tmp_path / "1.ply").write_bytes(head.format("binary_little_endian").encode() + little + b"\x03abc")
    (tmp_path / "2.ply").write_bytes(head.format("binary_big_endian").replace("\n", "\r\n").encode() + big)
    (tmp_path / "3.ply").write_bytes((head.format("ascii") + "".join(f"{v[0]} {v[1]} {v[2]} {v[3]}\n" for v in values)).encode() + b"3 0 1 2\n")
    (tmp_path / "notes.txt").write_text("not read")
    ply_source.register(spark)
    found = spark.read.format("ply").option("properties", "red,absent").option("splitBytes", width).option("batchRows", 2).load(str(tmp_path))
    want = [(s, 0, i, i + 0.5, float(-i), float(i * 7), float(200 + i), None) for s in (1, 2, 3) for i in range(5)]
    assert sorted(map(tuple, found.collect())) == want
    assert ply.decode((tmp_path / "2.ply").read_bytes())["z"].tolist() == [0, 7, 14, 21, 28]


def test_unreadable_files_name_themselves(spark, tmp_path):
    good = ply.encode(np.ones((3, 3)))
    for name, content, why in (("1", b"broken", "not a PLY file"), ("2", good[:-1], "ends early"), ("3", ply.encode(np.zeros((0, 3))), "empty"), ("4", good.replace(b"float z", b"quart z"), "quart"), ("5", ply.encode(np.ones((1, 2)), ("x", "y")), "no z"), ("6", b"", "not a PLY file"), ("7", b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n", "ends early")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.ply").write_bytes(content)
        (tmp_path / name / "9.ply").write_bytes(good)
        read = spark.read.format("ply").option("errors", "raise")
        with pytest.raises(Exception, match=f"{name}.ply: .*{why}"):
            read.load(str(tmp_path / name)).count()
        assert spark.read.format("ply").option("errors", "skip").load(str(tmp_path / name)).filter("scan_id = 9").count() == 3
    heads = spark.read.format("ply").option("heads", "true").load(str(tmp_path / "2")).orderBy("scan_id").collect()
    assert [(r.scan_id, r.n, r.error) for r in heads] == [(2, None, "the file ends early"), (9, 3, None)]


def test_written_and_read_in_order(spark, tmp_path):
    rows = [(s, i * 3, i * 0.5, -i * 1.0, float(s), i / 4) for s in (3, 4) for i in range(50)]
    points = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double, red double")
    path = str(tmp_path / "out")
    ply_source.write_clouds(points, path, ("red",), 7)
    want = sorted((s, i // 3, x, y, z, r) for s, i, x, y, z, r in rows)
    assert sorted(map(tuple, ply_source.read_clouds(spark, path, ("red",), 64).collect())) == want
    assert len(list((tmp_path / "out").glob("*.ply"))) >= 16 and not list((tmp_path / "out").glob("_*"))
    # appended points follow, overwriting leaves the new ones only
    ply_source.write_clouds(points.filter("scan_id = 3").limit(5), path, ("red",), 7, "append")
    assert sorted(r["count"] for r in ply_source.read_clouds(spark, path).groupBy("scan_id").count().collect()) == [50, 55]
    ply_source.write_clouds(points.filter("scan_id = 4"), path, (), 1000)
    assert [tuple(r) for r in ply_source.read_clouds(spark, path).groupBy("scan_id").count().collect()] == [(4, 50)]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    good = spark.range(10).select(F.lit(1).cast("long").alias("scan_id"), *(F.col("id").cast("double").alias(c) for c in "xyz"))
    ply_source.register(spark)
    good.write.format("ply").mode("append").save(str(path))
    before = sorted(p.name for p in path.iterdir())
    broken = good.repartition(4).withColumn("x", F.when(F.col("x") == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            broken.write.format("ply").mode(mode).save(str(path))
        assert sorted(p.name for p in path.iterdir()) == before
    assert spark.read.format("ply").load(str(path)).count() == 10
    with pytest.raises(Exception, match="no z"):
        good.drop("z").write.format("ply").mode("append").save(str(path))


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.ply").write_bytes(ply.encode(np.full((2, 3), float(k))))
    ply_source.register(spark)
    found = spark.read.format("ply").option("splitBytes", 20 * ply_source.OPEN_BYTES).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, found.select("scan_id", "point_id", "x").collect())) == [(k, i, float(k)) for k in range(40) for i in range(2)]
