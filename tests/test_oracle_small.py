"""Every query of the catalog against its DuckDB oracle on the small fixture."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from labelforge.plans import QUERIES
from labelforge.sources.tables import TABLES
from tests.conftest import SMALL


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert rows and all(v is not None for v in rows[0])
        return
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in rows]) == _rows(dcols, cur.fetchall())


def test_entry(spark):
    assert E.entry(spark).count() > 0
