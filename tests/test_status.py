"""The status machine against a plain replay; the keyed table under retries."""

import random

import pytest
from pyspark.sql import functions as F

from habitrace.streaming import jobs
from habitrace.streaming import status as machine
from habitrace.streaming.keyed_table import KeyedTable

HOUR = 3_600_000_000
BEGIN = 1_704_067_200_000_000


def replay(events, mark, idle):
    """One scan's shown rows, event by event in order of time."""
    order = ["extracting", "reconstructing", "cleaning", "understanding", "previewing", "done"]
    spans = dict(zip(order, [(5, 5), (15, 73), (75, 78), (88, 93), (95, 95), (100, 100)]))
    shown, run, now, value, seen = [], 1, None, None, None
    for t, i, s, f in sorted(events):
        if t > mark:
            continue
        if now in order[:5] and t - seen > idle:
            shown.append((run, "failed", 100, seen + idle, None))
            now = "failed"
        seen = t
        if s not in (*order, "failed"):
            seen = None if now is None else t
            continue
        v = 100 if s == "failed" else spans[s][0] + (spans[s][1] - spans[s][0]) * min(max(f or 0, 0), 1)
        if now == "done" or now == "failed" and s != "extracting":
            continue
        if now == "failed":
            run += 1
        elif now and s != "failed" and (order.index(s) < order.index(now) or s == now and v - value < 1):
            continue
        now, value = s, v
        shown.append((run, s, round(v), t, i))
    if now in order[:5] and seen + idle <= mark:
        shown.append((run, "failed", 100, seen + idle, None))
    return [(k + 1, *row) for k, row in enumerate(shown)]


def write(spark, rows, path, k):
    frame = spark.createDataFrame(rows, "scan_id long, event_id long, us long, status string, fraction double")
    frame.withColumn("ts", F.timestamp_micros("us")).drop("us").coalesce(1).write.parquet(f"{path}/{k}")


def test_any_order_and_repeats_equal_a_replay(spark, tmp_path):
    dice = random.Random(5)
    names = [*machine.STAGES, *(["extracting", "reconstructing", "cleaning", "failed"] * 4), "odd", None]
    rows = []
    for i in range(600):
        rows.append((i % 7, i, BEGIN + i * HOUR // 4 + dice.randrange(10**6), dice.choice(names), dice.choice([None, -1.0, 2.0, dice.random()])))
    rows += [(99, 9000, BEGIN, "extracting", None), (98, 9001, BEGIN, "nothing", None)]
    # a file spans 25 hours in any order, within a delay of 26; every row comes twice
    files = [rows[a : a + 100] for a in range(0, 600, 100)] + [rows[600:]]
    files[0] += files.pop()
    for k, part in enumerate(files):
        part = part * 2
        dice.shuffle(part)
        write(spark, part, str(tmp_path), k)
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/0").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = jobs.drain(spark, machine.transitions(stream, "26 hours", 5), "update", settings=machine.STORE).withColumn("us", F.unix_micros("at")).collect()
    mark = (max(r[2] for r in rows) // 1000 - 26 * 3_600_000) * 1000
    assert len(got) > 50
    for scan in {r[0] for r in rows}:
        want = replay([(r[2], r[1], r[3], r[4]) for r in rows if r[0] == scan], mark, 5 * HOUR)
        mine = sorted((r.seq, r.attempt, r.status, r.progress, r.us, r.event_id) for r in got if r.scan_id == scan)
        assert mine == want, scan
    assert not [r for r in got if r.scan_id == 98]
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


def test_rules():
    at = machine.State(3, 1, "reconstructing", 20.0, 0)
    event = lambda s, f=None: machine.Event(5, 1, s, f)
    assert machine.advanced(at, event("extracting")) is None
    assert machine.advanced(at, event("reconstructing", 0.1)) is None
    assert machine.advanced(at, event("reconstructing", 0.2)).value == pytest.approx(26.6)
    failed = machine.advanced(at, event("failed"))
    assert failed.value == 100 and machine.advanced(failed, event("done")) is None
    assert machine.advanced(failed, event("extracting")).attempt == 2
    assert machine.advanced(machine.advanced(at, event("done")), event("failed")) is None


def test_keyed_table_under_retries(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["v"], 4)
    assert t.read() is None
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long, s string")
    rows = lambda: sorted(map(tuple, t.read().select("k", "v", "s").collect()), key=str)
    assert t.merge(frame([(1, 1, "a"), (2, 1, "b"), (None, 1, "n"), (1, None, "x")]), 0)
    first = [(1, 1, "a"), (2, 1, "b"), (None, 1, "n")]
    assert rows() == first
    # a batch that dies between its rows and its manifest changes nothing that is read
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        later = spark.range(1).select(F.lit(1).cast("long").alias("k"), F.lit(9).cast("long").alias("v"), F.lit("z").alias("s"))
        with pytest.raises(OSError):
            t.merge(later, 1)
    assert rows() == first
    assert t.merge(frame([(1, 9, "z"), (3, 2, "c")]), 1)
    second = [(1, 9, "z"), (2, 1, "b"), (3, 2, "c"), (None, 1, "n")]
    assert rows() == second
    assert not t.merge(frame([(1, 99, "wrong")]), 1)
    assert t.merge(frame([]), 2) and rows() == second
    assert t.vacuum() > 0 and rows() == second
    assert t.merge(frame([(2, 0, "older"), (3, 2, "d")]), 3)
    assert rows() == [(1, 9, "z"), (2, 1, "b"), (3, 2, "d"), (None, 1, "n")]


def test_keyed_table_from_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, k, f"{k}") for i in range(k, 5)], "k long, v long, s string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("k long, v long, s string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["v"])
    t.start(stream, str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, t.read().select("k", "v").collect())) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)]
