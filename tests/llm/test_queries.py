"""The registered corpus queries: against their SQL where there is one, and the pipeline as its stages say."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import queries
from tidemark.session import table

from ..conftest import SF_DIR
from ..test_queries import TABLES, agrees


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, duck, key):
    agrees(spark, duck, queries.QUERIES[key], queries.ORACLES[key])


def test_all_are_registered():
    names = entry.queries()
    assert {int(k[2:].split("_")[0]) for k in names if k.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_stages_work_on_what_is_left(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, before = docs.columns, Counter(r.doc_id for r in docs.collect())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF_DIR)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        now = Counter(r.doc_id for r in rows)
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert not now - before and rows
        if i == 3:
            assert set(now) <= set(before) and max(now.values()) <= 3
        if i == 4:
            assert now == before
        before = now
