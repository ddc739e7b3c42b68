"""Every query against its SQL on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelode.plans import catalogue

SIZES = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not SIZES, reason="no tables here")


@pytest.fixture(scope="module", params=SIZES, ids=os.path.basename)
def tables(request):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{request.param}/{t}.parquet'")
    return request.param, c


def plain(v):
    """Values as they are compared: exactly, but for NaN (null) and the sign of zero."""
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, tables, name):
    sf_dir, db = tables
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = db.execute(catalogue.ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    order = sorted(range(len(cols)), key=cols.__getitem__)
    want = sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=str)
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]][:3] == []


def test_all_queries_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    queries = entry.queries()
    assert set(catalogue.QUERIES) <= set(queries)
    assert set(entry.oracle_sql()) <= set(queries)
