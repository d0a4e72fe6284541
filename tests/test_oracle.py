"""Every query with SQL gives what DuckDB gives on the same tables; the others run and keep their columns."""

import glob
import math
import os

import duckdb
import pytest

from gristworks.plans import ORACLES, QUERIES, flagship


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    try:
        return round(float(v), 6) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(repr(tuple(norm(r[i]) for i in at)) for r in got.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_flagship(spark, small):
    assert flagship(spark, small).count() > 0


def test_registered_names_have_queries():
    assert set(ORACLES) <= set(QUERIES)
