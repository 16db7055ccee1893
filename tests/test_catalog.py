"""Every registered query of the engine against its SQL on DuckDB, over the smallest tables."""

import datetime as dt
import decimal

import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{round(v, 4) + 0.0:.4f}"
    if isinstance(v, dt.datetime):
        return str(v.replace(tzinfo=None))
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql()[name]
    columns = sorted(df.columns)
    found = duck.sql(sql)
    assert columns == sorted(found.columns)
    places = [found.columns.index(c) for c in columns]
    got = sorted([_plain(r[c]) for c in columns] for r in df.collect())
    want = sorted([_plain(r[i]) for i in places] for r in found.fetchall())
    assert got == want
