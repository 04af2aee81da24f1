"""Every registered query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from habitrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return ""
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_oracle_names_are_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
