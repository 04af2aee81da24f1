"""Queries on tables that the driver's small ones don't show: folders, ties, sums in any order."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from habitrace.operators import exact
from habitrace.plans import registry

KINDS = np.array(["view", "click", "error", "signup", "purchase"])


def _rows(spark, sf_dir, name):
    return sorted(map(tuple, registry.queries()[name](spark, str(sf_dir)).collect()), key=str)


def test_object_listing_of_folders(spark, tmp_path):
    for name, parts in (("pages", 3), ("part", 0), ("orders", 2)):
        rows = spark.range(6)
        if parts:
            rows.repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            rows.toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    assert _rows(spark, tmp_path, "object_listing") == [("pages.parquet",), ("part.parquet",)]


def _same(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def _against_sql(spark, folder, name):
    """(rows of the query, rows of its SQL), which one thread reads in the order of the files."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    frame = registry.queries()[name](spark, str(folder))
    cols = sorted(frame.columns)
    want = con.execute(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall()
    return [sorted((tuple(map(_same, r)) for r in rows), key=str) for rows in (frame.select(cols).collect(), want)]


def _store(folder, events, files):
    (folder / "events.parquet").mkdir(parents=True)
    for k, part in enumerate(np.array_split(np.arange(len(events)), files)):
        events.iloc[part].to_parquet(folder / f"events.parquet/part-{k:04d}.parquet")


def _events(n, scans, values, rng):
    return pd.DataFrame({
        "event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s").astype("timedelta64[us]"), "user_id": rng.integers(0, scans, n),
        "event_type": KINDS[rng.integers(0, 5, n)], "value": values, "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, n)],
    }).astype({"ts": "datetime64[us]"})


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Values whose averages meet limits, labels with equal sums, and quantiles from which values are whole bins away; in twelve files."""
    rng = np.random.default_rng(31)
    n, scans = 40_000, 250
    events = _events(n, scans, np.zeros(n), rng)
    events["user_id"], events["event_type"] = np.arange(n) // 5 % scans, KINDS[np.arange(n) % 5]
    limits = np.array([[40, 30, 20, 25, 50], [45, 40, 30, 62.5, 20], [20] * 5, [30] * 5])
    events["value"] = np.round(limits[events.user_id % 4, np.arange(n) % 5] + rng.integers(-1, 2, n) / 10, 2)
    more = []
    for k in range(300):
        low, gap = rng.integers(100, 3000), 5 * rng.integers(1, 200)
        values = [low - 100, low, low + gap, *[low + gap * 3 // 5 + 500 + 500 * (k % 3)] * 24, *[low + gap * 3 // 5 + 2100] * 6]  # a twentieth of the way lies at 1.6
        more += [(1000 + k, "view", v / 100) for v in values]
        mid, gap = 5 * rng.integers(100, 2000), 4 * rng.integers(1, 100)
        low, high = mid * 2 // 5, mid * 8 // 5  # quartiles of six values lie at 1.25 and 3.75, and 1.2 middles apart
        more += [(2000 + k, "click", v / 100) for v in (low - gap, low - gap // 4, low + gap * 3 // 4, high - gap * 3 // 4, high + gap // 4, high + gap)]
    made = _events(len(more), 1, [v for *_, v in more], rng)
    made["event_id"], made["user_id"], made["event_type"] = made.event_id + n, [u for u, *_ in more], [t for _, t, _ in more]
    folder = tmp_path_factory.mktemp("tied")
    _store(folder, pd.concat([events, made]), 12)
    return folder


@pytest.mark.parametrize("name", ["confidence_minimum", "hist_step_height", "iqr_gate", "label_shares", "observation_status", "risk_bands", "risk_completeness", "risk_geometry_kinds", "risk_levels", "risk_score", "risk_status_counts"])
def test_ties_fall_as_in_the_sql(spark, tied, name):
    got, want = _against_sql(spark, tied, name)
    assert len(got) > 1 and got == want


@pytest.mark.parametrize("name", ["iqr_gate", "label_shares", "hist_step_height", "observation_status", "confidence_minimum", "risk_levels"])
def test_odd_events(spark, tmp_path, name):
    """Null scans, kinds and values, labels that weigh nothing, values that are not finite."""
    rng = np.random.default_rng(32)
    n = 3000
    e = _events(n, 12, np.round(rng.exponential(50, n), 2), rng)
    e["value"] = e.value.mask(e.user_id == 1, 0.0).mask(e.event_id % 101 == 0, -e.value).mask((e.user_id == 3) & (e.event_type == "error"), np.inf)
    view = spark.createDataFrame(e[["event_id", "user_id", "event_type", "value", "props"]]).selectExpr(
        "event_id", "timestamp'2024-01-01' as ts", "if(event_id % 97 = 0, null, user_id) as user_id", "if(event_id % 103 = 0, null, event_type) as event_type",
        "case when user_id = 2 or user_id = 5 and event_type = 'view' or event_id % 89 = 0 then null when user_id = 4 and event_type = 'click' then double('nan') else value end as value", "props",
    )
    view.coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    got, want = _against_sql(spark, tmp_path, name)
    assert got == want


def test_quantiles_of_few_values(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, None), (2, None), (3, 1.0), (3, 2.0), (3, 2.0), (3, 4.0), (4, -1.0), (4, float("inf"))], "g long, v double")
    got = {r.g: (r.total, r.low, r.mid) for r in exact.quantiles(rows, ["g"], "v", {"low": 0.25, "mid": 0.5}).collect()}
    assert got == {1: (2, 1.0, 1.0), 2: (1, None, None), 3: (4, 1.75, 2.0), 4: (2, float("inf"), float("inf"))}
