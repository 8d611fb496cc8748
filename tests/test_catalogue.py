import glob
import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalogue

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SAMPLE}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(rows):
    return sorted([tuple(round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    got = catalogue.QUERIES[name](spark, SAMPLE)
    if name in catalogue.ORACLES:
        want = tables.sql(catalogue.ORACLES[name])
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert plain(got.select(*columns).collect()) == plain(tables.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
    else:
        assert got.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
