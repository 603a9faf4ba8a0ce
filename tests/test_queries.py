"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import registry

from .conftest import SF_DIR

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type and DuckDB type that hold the same values.
SAME_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _comparable(rows):
    def value(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(value(v) for v in row) for row in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, duck, key):
    agrees(spark, duck, entry.queries()[key], entry.oracle_sql()[key])


def agrees(spark, duck, query, sql):
    df = query(spark, SF_DIR)
    columns = sorted(df.columns)
    rows = _comparable(df.select(columns).collect())
    assert rows, "a query must find something on the small tables"
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {f.name: SAME_TYPES[f.dataType.simpleString()] for f in df.schema} == types
    at = [relation.columns.index(c) for c in columns]
    assert rows == _comparable(tuple(row[i] for i in at) for row in relation.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
