"""Every registered query against its SQL in DuckDB, or that it gives rows."""

import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__  # noqa: E402
from check import connect, plain  # noqa: E402

QUERIES = __spark_entry__.queries()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(data) -> duckdb.DuckDBPyConnection:
    return connect(data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in cursor.fetchall()]
    assert Counter(rows) == Counter(expected)


def test_entry(spark):
    assert {r["split"] for r in __spark_entry__.entry(spark).collect()} == {"train", "valid"}
