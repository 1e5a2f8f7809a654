"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    assert got[1]
    if name in ORACLE_SQL:
        c = tables.execute(ORACLE_SQL[name])
        names = [x[0] for x in c.description]
        assert got == rows(names, c.fetchall())
