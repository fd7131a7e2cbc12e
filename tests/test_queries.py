"""Every query with a SQL twin equals DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from voxelweave.queries import base, knowledge, more, scene, wide  # noqa: F401

from .conftest import SF

SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in base.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(set(base.SQL) - SLOW))
def test_twin(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    cur = duck.execute(base.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.SQL)))
def test_runs(spark, name):
    df = base.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
