"""Every registered query with an oracle: Spark result == DuckDB SQL result
(row count, column names, order-insensitive values) on the given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from hubflow.plans import registry

SF = os.environ.get("HUBFLOW_TEST_SF", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"]
registry.load_all()
SQL = registry.ORACLE  # the library's own; the training-data queries are tested beside their code


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(records, cols):
    order = sorted(cols)
    out = [tuple(_norm(r[c]) for c in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = [r.asDict(recursive=True) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    want = [dict(zip(ocols, r)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _rows(got, df.columns) == _rows(want, ocols)


def test_every_query_has_a_callable(spark):
    q = E.queries()
    assert set(SQL) <= set(q)
    assert len(q) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "edge_weight" in df.columns
