"""Registered queries over all rows of their tables, against brute force; their SQL is not asked."""

import re

import numpy as np
import pytest

from habitrace.plans import registry
from habitrace.plans.texts import PROMPTS
from habitrace.sources.driver_tables import boxes, points


@pytest.fixture(scope="module")
def inside(spark, sf_dir):
    p, b = points(spark, sf_dir).toPandas(), boxes(spark, sf_dir).toPandas()
    found = set()
    for box in b.itertuples():
        near = p[p.scan_id == box.scan_id]
        dx, dy, dz = near.x * 10 - box.cx, near.y * 10 - box.cy, near.z * 10 - box.cz
        c, s = np.cos(box.yaw), np.sin(box.yaw)
        hit = (abs(c * dx + s * dy) <= box.sx / 2 + 0.12) & (abs(c * dy - s * dx) <= box.sy / 2 + 0.12) & (abs(dz) <= box.sz / 2 + 0.08)
        found |= {(box.scan_id, point, box.box_id) for point in near.point_id[hit]}
    return found


def test_points_in_all_boxes(spark, sf_dir, inside):
    got = registry.queries()["point_in_box"](spark, sf_dir).collect()
    assert len(got) == len(inside) and {(r.scan_id, r.point_id, r.box_id) for r in got} == inside
    assert {b % 7 for _, _, b in inside} == set(range(7))


def test_support_of_all_boxes(spark, sf_dir, inside):
    count = {}
    for _, _, b in inside:
        count[b] = count.get(b, 0) + 1
    got = registry.queries()["box_support_filter"](spark, sf_dir).collect()
    assert {(r.box_id, r.support) for r in got} == {(b, n) for b, n in count.items() if n >= 3}


def test_label_of_whole_texts(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    late = docs.limit(1).selectExpr("-1L as doc_id", "repeat('x ', 300) || 'THE' as text")
    late.unionByName(docs.select("doc_id", "text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.label for r in registry.queries()["label_from_text"](spark, str(tmp_path)).collect()}

    def label(text):
        clean = re.sub(" +", " ", (text or "").lower().replace(".", " ")).strip(" ")
        return next((name for word, name in PROMPTS if word in clean), "other")

    assert got == {-1: "article"} | {r.doc_id: label(r.text) for r in docs.collect()}
