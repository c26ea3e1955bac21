"""The queries SQL can express, against DuckDB on the same tables."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from bookwise.llm import oracles

from conftest import SF_DIR


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = con.execute(oracles.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == theirs


def test_all_queries_are_registered():
    names = [q for q in entry_points.queries() if q.startswith("op") and q[2:].split("_")[0].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in entry_points.queries()
