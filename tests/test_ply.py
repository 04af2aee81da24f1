import numpy as np
import pytest

from habitrace.sources import ply


def test_decode_rejects_bad_files():
    good = ply.encode(np.arange(6.0).reshape(2, 3))
    assert ply.decode(good)["y"].tolist() == [1.0, 4.0]
    for bad in (b"", b"plx", good[:-3], ply.encode(np.zeros((0, 3)))):
        with pytest.raises(ValueError):
            ply.decode(bad)


def test_ascii_and_other_properties():
    text = b"ply\nformat ascii 1.0\nelement vertex 1\nproperty double x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n1.5 2 3 255\n"
    v = ply.decode(text)
    assert v["x"][0] == 1.5 and v["red"][0] == 255


def test_round_trip_and_files(spark, tmp_path):
    rows = [(s, i, i * 0.5, -i * 1.0, float(s)) for s in (3, 4) for i in range(7)]
    points = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double")
    files = ply.encoded(points, 5)
    assert files.count() == 4
    assert sorted((r.scan_id, r.x, r.y, r.z) for r in ply.decoded(files).collect()) == sorted((s, x, y, z) for s, _, x, y, z in rows)
    for r in files.collect():
        (tmp_path / f"{r.scan_id}_{r.part}.ply").write_bytes(r.content)
    (tmp_path / "9.ply").write_bytes(b"broken")
    assert ply.read_ply(spark, str(tmp_path), errors="skip").groupBy("scan_id").count().orderBy("scan_id").collect() == [(3, 7), (4, 7)]


def test_unreadable_files_are_told(spark, tmp_path):
    """A broken, an empty and an odd file: an error by default, a row that says why on demand."""
    (tmp_path / "1.ply").write_bytes(ply.encode(np.arange(6.0).reshape(2, 3)))
    (tmp_path / "2.ply").write_bytes(b"broken")
    (tmp_path / "3.ply").write_bytes(ply.encode(np.zeros((0, 3))))
    (tmp_path / "4.ply").write_bytes(ply.encode(np.zeros((1, 3))).replace(b"float z", b"quart z"))
    (tmp_path / "5.ply").write_bytes(ply.encode(np.ones((1, 2)), ("x", "y")))
    rows = ply.read_ply(spark, str(tmp_path), errors="rows").collect()
    assert sum(r.error is None for r in rows) == 2
    assert {r.scan_id: r.error for r in rows if r.error} == {2: "not a PLY file", 3: "the cloud is empty", 4: "unknown property type quart", 5: "no z"}
    with pytest.raises(Exception, match="scan [2345]: "):
        ply.read_ply(spark, str(tmp_path)).collect()


def test_line_ends_and_colours(spark):
    six = np.arange(12.0).reshape(2, 6)
    content = ply.encode(six, ("x", "y", "z", "nx", "ny", "nz"))
    head, _, rest = content.partition(b"end_header\n")
    v = ply.decode(head.replace(b"\n", b"\r\n") + b"end_header\r\n" + rest)
    assert v["nz"].tolist() == [5.0, 11.0]
    points = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 0.5)], "scan_id long, point_id long, x double, y double, z double, red double")
    assert [tuple(r) for r in ply.decoded(ply.encoded(points, extra=("red",)), ("red",)).collect()] == [(1, 0, 1.0, 2.0, 3.0, 0.5)]
