"""Every query with an oracle equals DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import numpy as np
import pytest

from folioflow import registry

registry.load()

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    q = duck.sql(registry.ORACLES[name])
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    assert ordered(rows) == ordered([tuple(plain(r[i]) for i in at) for r in q.fetchall()])
