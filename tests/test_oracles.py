"""Every registered query against its SQL counterpart."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

from conftest import SF_DIR

import __spark_entry__ as entry_points
from bookwise.plans import oracles

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(oracles.all_sql()))
def test_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = Counter(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    result = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(_plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_returns_rows(spark):
    assert entry_points.entry(spark).count() > 0
