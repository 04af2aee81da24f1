"""Clouds of several files keep one numbering per scan."""

from habitrace.sources import ply


def test_numbers_go_through_parts(spark, tmp_path):
    rows = [(s, i, i * 0.5, -i * 1.0, float(s)) for s in (3, 4) for i in (0, 1, 2, 4, 5, 31, 32, 40)]
    points = spark.createDataFrame(rows, "scan_id long, point_id long, x double, y double, z double")
    want = [(s, k, x, y, z) for s in (3, 4) for k, (_, _, x, y, z) in enumerate(r for r in rows if r[0] == s)]
    files = ply.encoded(points, 3)
    assert files.count() == 8
    assert sorted(map(tuple, ply.decoded(files).collect())) == want
    for r in files.collect():
        (tmp_path / f"{r.scan_id}_{r.part}.ply").write_bytes(r.content)
    (tmp_path / "3_1000.ply").write_bytes(b"broken")
    assert sorted(map(tuple, ply.read_ply(spark, str(tmp_path), errors="skip").collect())) == want
