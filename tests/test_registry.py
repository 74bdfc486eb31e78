"""Every registered query against its SQL counterpart, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from ledgerloom.registry import all_queries

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = ("part", "orders", "lineitem", "events", "documents", "pages", "customer")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if hasattr(value, "tzinfo"):
        value = value.replace(tzinfo=None)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(comparable(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("query", all_queries(), ids=lambda q: q.name)
def test_query(spark, duck, query):
    df = query.build(spark, str(SF_DIR))
    found = table(df.columns, [tuple(r) for r in df.collect()])
    assert found[1]
    if query.sql is not None:
        result = duck.execute(query.sql)
        expected = table([c[0] for c in result.description], result.fetchall())
        assert found[0] == expected[0]
        assert found[1] == expected[1]


def test_names_are_unique():
    names = [q.name for q in all_queries()]
    assert len(names) == len(set(names))


def test_orders_of_the_whole_run_are_registered(spark):
    built = {q.name: q for q in all_queries()}
    whole, part = (built[n].build(spark, str(SF_DIR)) for n in ("returns_orders", "returns_orders_of_part"))
    assert built["returns_orders"].sql and whole.count() > part.count()
