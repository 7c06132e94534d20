"""Queries of the subpackage against their SQL, as the driver compares them."""

import os

import duckdb
import pytest

from textloom.llm import registry

from ..test_plans import DATA, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    relation = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())
