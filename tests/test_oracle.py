"""Every query that has SQL is run on both sides over the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def _plain(x):
    if isinstance(x, list):
        return str([_plain(y) for y in x])
    if x is None or x != x:
        return "~"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def _names():
    from quarry.plans import catalog

    return sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, db, name):
    from quarry.plans import catalog

    df = catalog.queries()[name](spark, SF)
    want = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, want.fetchall())
