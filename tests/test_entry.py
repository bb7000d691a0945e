"""The registered queries against their SQL, on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    got = collections.Counter(repr(tuple(r)) for r in df.collect())
    if name in plans.ORACLES:
        rel = db.sql(plans.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        at = [rel.columns.index(c) for c in df.columns]
        assert got == collections.Counter(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    else:
        assert got


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
