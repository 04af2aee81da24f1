"""The stages in order, each against a brute-force version of its decision."""

import zlib

import corpus_pipeline
from habitrace.llm import decontaminate, simhash


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(steps) and len(steps) == 5
    good = steps["quality classifier"](spark, docs, sf_dir)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert good.columns == docs.columns
    assert sum((d in kept) == (labels[d] == 1) for d in held) / len(held) > 0.9

    one = steps["SimHash near-dedup"](spark, good, sf_dir)
    prints = {r.doc_id: simhash.fingerprint_of(r.text.encode()) for r in good.collect()}
    label = {i: i for i in prints}
    while True:
        new = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == label:
            break
        label = new
    assert {r.doc_id for r in one.collect()} == set(label.values())

    clean = steps["benchmark decontamination"](spark, one, sf_dir)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not decontaminate.brute_force(r.text, items)[1]}

    mixed = steps["mixing to target weights"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= clean.count()
    out = steps["token-ID output"](spark, mixed, sf_dir).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in mixed.collect()}
    assert sorted(r.start for r in out)[0] == 0
