"""Every query with a DuckDB twin gives its rows; the others run."""

import datetime
import decimal
import os

import duckdb
import pytest

from loomgraph.plans import queries as q
from loomgraph.sources.star import TABLES

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    df = q.queries()[name](spark, BASE)
    sql = q.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    res = duck.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in res.description}
    want = sorted((tuple(map(plain, r)) for r in res.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want
    mine = {c: t.replace("timestamp_ntz", "timestamp") for c, t in df.dtypes}
    assert mine == kinds
