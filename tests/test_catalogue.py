"""Every query of the engine against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pytest

from lumengraph import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    columns = [c[0] for c in got.description]
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    assert sorted(columns) == sorted(df.columns)
    assert rows == sorted(tuple(plain(r[k]) for k in order) for r in got.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.queries()) <= set(e.queries())
    assert e.entry(spark).columns == ["answer_id", "films", "first_film", "last_film"]
