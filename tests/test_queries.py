"""Every query against its SQL oracle on the smallest tables."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from strandmill.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8)
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr([plain(row[c]) for c in columns]) for row in df.collect())
    spark.catalog.clearCache()
    if name in catalog.ORACLES:
        found = oracle.sql(catalog.ORACLES[name])
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(repr([plain(row[i]) for i in at]) for row in found.fetchall())
