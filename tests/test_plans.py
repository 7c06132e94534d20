"""Every registered query against its SQL, as the driver compares them: columns by name, values in any order."""

import os

import duckdb
import pytest

from textloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([key(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in registry.ORACLE_SQL:
        relation = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(relation.columns)
        assert rows(df.columns, got) == rows(relation.columns, relation.fetchall())


def test_cross_file_suffixes_are_greedy(spark):
    got = registry.QUERIES["id_suffix_cross_file"](spark, DATA).orderBy("doc_id", "line").collect()
    used = {}
    for r in got:
        taken = used.setdefault(r.key.split("_")[0], set())
        name, i = r.key, 0
        while name in taken:
            i += 1
            name = f"{r.key}_{i}"
        taken.add(name)
        assert r.unique_key == name
