"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from outlyr.plans import registry
from outlyr.session import TABLES


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, con):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLE:
        assert ours
        return
    q = con.execute(registry.ORACLE[name])
    names = [d[0] for d in q.description]
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
    assert sorted(names) == cols
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
