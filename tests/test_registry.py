"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from alertloom.plans.oracles import all_sql
from alertloom.plans.queries import REGISTRY

FOLDER = Path("/root/testdata/sf0.001")
TABLES = ("events", "documents", "pages", "labels", "conversations")


def _text(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def test_every_query_has_sql_and_every_sql_a_query():
    assert set(REGISTRY) == set(all_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    rows = REGISTRY[name](spark, str(FOLDER))
    cursor = connection.execute(all_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(rows.columns) == sorted(columns)
    assert _sorted([tuple(r) for r in rows.collect()], rows.columns) == _sorted(cursor.fetchall(), columns)
