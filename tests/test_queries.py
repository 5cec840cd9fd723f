"""Every query with a twin gives DuckDB's rows."""

import duckdb
import pytest

from siftworks.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLES:
        q = duck.execute(ORACLES[name])
        names = [d[0] for d in q.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
        assert got == want
    else:
        assert got
