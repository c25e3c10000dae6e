"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import math
import os

import duckdb
import pytest

from shelfprice.plans import catalogue, upkeep

from .conftest import SF

QUERIES, ORACLES = catalogue.QUERIES | upkeep.QUERIES, catalogue.ORACLES | upkeep.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v) if hasattr(v, "isoformat") else float(v) if hasattr(v, "__float__") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    if name in ORACLES:
        sql = db.sql(ORACLES[name])
        assert sorted(sql.columns) == columns
        assert got == sorted((tuple(map(plain, r)) for r in sql.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
