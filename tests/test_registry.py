"""Every query with SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

from colophon.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in ORACLE_SQL:
        rel = con.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert got == rows(rel.columns, rel.fetchall())
    else:
        assert got
