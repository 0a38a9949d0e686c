"""Every query with an SQL twin gives the twin's rows."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from tallymark import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    own = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert own == sorted((tuple(plain(dict(zip(columns, row))[c]) for c in names) for row in found.fetchall()), key=repr)
    assert own


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
