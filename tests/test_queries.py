"""Every relational query against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as e
from agoraflow.plans import registry
from agoraflow.sources.tables import NAMES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_contract(spark):
    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sanitized_pages(spark):
    safe = [r.safe for r in registry.QUERIES["html_sanitize"](spark, SF).collect()]
    assert safe and not any("<script" in x or "track(" in x for x in safe)
