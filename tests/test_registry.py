"""Every registered query runs; those with SQL give what DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF
from pagevault.plans import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if isinstance(v, int) else str(v)


def table(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = table(df.select(*[f"`{c}`" for c in cols]).collect())
    sql = all_oracles().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == table(tuple(r[i] for i in order) for r in cur.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
