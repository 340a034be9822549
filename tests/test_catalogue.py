"""Every registered core query runs, and equals its SQL where it has one."""

import glob
import os

import duckdb
import pytest

from storyflow.plans import catalogue


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, small, db, name):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalogue.ORACLES:
        found = db.sql(catalogue.ORACLES[name])
        assert sorted(found.columns) == columns
        want = sorted((tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
        assert got == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
