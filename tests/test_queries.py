"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from quarry.jobs import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def text(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return str(int(v)) if v == math.floor(v) and abs(v) < 1e15 else f"{v:.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(tuple(text(r[i]) for i in at) for r in result.fetchall()) == rows
