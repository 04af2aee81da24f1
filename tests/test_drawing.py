"""Shapes of risks and outlines of plans on small made rooms."""

import math

import pytest

from habitrace.operators import drawing

RISK = "scan_id long, risk_id long, code string, level string, obstacles array<struct<label string, boxed boolean>>"
MEASURE = "scan_id long, passage_width double, narrowest array<double>, threshold double"
OBJECT = "scan_id long, object_id long, label string, center array<double>, axes array<double>, extents array<double>"


def test_risk_shapes(spark):
    axes = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    risks = [
        (1, 1, "passage_width", "red", None), (1, 2, "threshold", "yellow", None), (1, 3, "passage_width", "green", None), (1, 4, "threshold", "unknown", None), (1, 5, "slope", "red", None),
        (1, 6, "obstacle", "green", [("chair", True), ("chair", False), ("lamp", True), (None, True), ("table", True), ("gone", True), ("chair", True), ("bed", None)]),
        (1, 7, "obstacle", "red", None), (2, 1, "passage_width", "yellow", None), (2, 2, "threshold", "red", None), (3, 1, "passage_width", "red", None), (3, 2, "threshold", "red", []), (4, 1, "passage_width", "red", None), (None, 1, "threshold", "red", None), (1, 8, "passage_width", None, None),
    ]
    measures = [(1, 0.6, [2.0, 3.0, 0.5], 0.03), (2, 0.8, None, 0.0), (3, None, [1.0, 1.0, 1.0], None)]
    objects = [(1, 4, "chair", [9.0] * 3, axes, [9.0] * 3), (1, 2, "chair", [1.0, 2.0, 3.0], axes, [0.5] * 3), (1, 3, "lamp", [1.0] * 3, None, [1.0] * 3), (1, 5, "table", [1.0] * 3, axes, []), (1, 6, "obstacle", [7.0] * 3, axes, [2.0] * 3), (2, 1, "gone", [1.0] * 3, axes, [1.0] * 3)]
    made = [spark.createDataFrame(r, s) for r, s in ((risks, RISK), (measures, MEASURE), (objects, OBJECT))]
    got = sorted((tuple(r) for r in drawing.risk_shapes(*made).collect()), key=lambda r: r[:3])
    segment = lambda s, i, level, a, b, w: (s, i, 0, "segment", f"clear width {w:.2f} m", level, a, b, None, None, None)
    box = lambda k, label, c, e: (1, 6, k, "box", label, "green", None, None, [*c], axes, [*e])
    assert got == [
        segment(1, 1, "red", [1.7, 3.0, 0.5], [2.3, 3.0, 0.5], 0.6), (1, 2, 0, "arrow", "threshold 0.03 m", "yellow", [0.0] * 3, [0.0, 0.0, 0.03], None, None, None),
        box(0, "chair", (1.0, 2.0, 3.0), [0.5] * 3), box(3, "obstacle", [7.0] * 3, [2.0] * 3), box(6, "chair", (1.0, 2.0, 3.0), [0.5] * 3), segment(2, 1, "yellow", [-0.4, 0.0, 0.02], [0.4, 0.0, 0.02], 0.8),
    ]
    named = drawing.risk_shapes(*made, texts={"threshold": "Schwelle %.2f"}).filter("kind = 'arrow'").first()
    assert named.label == "Schwelle 0.03"
    assert drawing.risk_shapes(made[0].limit(0), *made[1:]).count() == 0 and drawing.risk_shapes(made[0], made[1].limit(0), made[2].limit(0)).count() == 0


def test_plan_outlines(spark):
    rooms = spark.createDataFrame([(1, 0.0, 4.0, 0.0, 3.0), (2, -1.0, 1.0, -1.0, 1.0)], "scan_id long, lo_x double, hi_x double, lo_y double, hi_y double")
    openings = [(1, 1, "door", 0.0, 1.0, 0.9, 90.0), (1, 2, "window", 4.0, 2.0, None, -90.4), (1, 3, "door", 1.0, 3.0, 0.0, 180.0), (1, 4, "window", None, None, 1.0, None), (9, 1, "door", 0.0, 0.0, 1.0, 0.0)]
    objects = [(1, 3, "bed", 1.0, 1.0, 2.0, 1.4, 30.0, None), (1, 1, "bed", 3.0, 1.0, None, 0.0, None, None), (1, 2, "shelf", 1.0, 1.0, 1.0, 1.0, 0.0, 1), (1, 5, None, 2.0, 2.0, 1.0, 0.5, 90.0, None)]
    obstacles = [(1, 1, 2.0, 2.0, 0.2, 0.6, 0.0), (1, 2, 2.0, 2.0, 0.07, 0.6, 0.0), (1, 3, 2.0, 2.0, 0.08, 0.08, 45.0), (1, 4, 2.0, 2.0, None, 0.6, 0.0)]
    item = "scan_id long, item_id long, "
    made = [spark.createDataFrame(r, item + s) for r, s in ((openings, "label string, cx double, cy double, width double, degrees double"), (objects, "label string, cx double, cy double, length double, width double, degrees double, attached_to long"), (obstacles, "cx double, cy double, sx double, sy double, degrees double"))]
    got = {}
    for r in drawing.plan_outlines(rooms, *made).orderBy("corner").collect():
        got.setdefault((r.scan_id, r.layer, r.item_id), []).append(r)

    def at(key, number, text, cx, cy, hx, hy, degrees=0.0):
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        rows = got.pop(key)
        assert (rows[0].number, rows[0].text_x, rows[0].text_y) == (number, *map(pytest.approx, text))
        assert [(r.x, r.y) for r in rows] == [pytest.approx((cx + i * hx * c - j * hy * s, cy + i * hx * s + j * hy * c)) for i, j in ((-1, -1), (-1, 1), (1, 1), (1, -1))]

    at((1, "floor", 0), 1, (2, -0.28), 2, 1.5, 2, 1.5)
    at((2, "floor", 0), 1, (0, -1.28), 0, 0, 1, 1)
    at((1, "opening", 1), 1, (0.24, 1), 0, 1, 0.09, 0.45)
    at((1, "opening", 2), 1, (3.76, 2), 4, 2, 0.09, 0.4)
    at((1, "opening", 3), 1, (1, 2.78), 1, 3, 0.4, 0.09)
    at((1, "opening", 4), 1, (2, 1.72), 2, 1.5, 0.5, 0.09)
    at((1, "object", 1), 1, (3, 1), 3, 1, 0.1, 0.1)
    at((1, "object", 3), 2, (1, 1), 1, 1, 1.0, 0.7, 30)
    at((1, "object", 5), 1, (2, 2), 2, 2, 0.5, 0.25, 90)
    at((1, "obstacle", 1), 1, (2, 2), 2, 2, 0.3, 0.1)
    at((1, "obstacle", 3), 1, (2, 2), 2, 2, 0.04, 0.04, 45)
    # an obstacle with one known side is as wide as that side: Spark's least passes over nulls
    at((1, "obstacle", 4), 1, (2, 2), 2, 2, 0.3, 0.3)
    assert not got and drawing.plan_outlines(rooms.limit(0), *made).count() == 0


def test_listed_gaps(spark):
    rows = [(1, k, k + 1, "bed" if k in (7, 9) else "chair", "bed" if k == 3 else None, None if k == 0 else 0.0 if k == 9 else 0.1 * k) for k in range(14)]
    got = drawing.listed_gaps(spark.createDataFrame(rows, "scan_id long, first_id long, second_id long, first_label string, second_label string, gap double")).orderBy("place").collect()
    assert [(r.place, r.first_id) for r in got] == list(enumerate([3, 7, 1, 2, 4, 5, 6], 1))
