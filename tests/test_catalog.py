"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(catalog.ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert [names[k] for k in order] == columns
    assert ours == sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())
