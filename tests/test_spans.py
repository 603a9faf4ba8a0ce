"""Spans of statements cut out what the column function splits."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import spans, text

SCHEMA = "i int, script string"


def found(spark, scripts, quotes=False):
    df = spark.createDataFrame(list(enumerate(scripts)), SCHEMA)
    rows = spans.statement_spans(df, "script", quotes).orderBy("i", "number").collect()
    cut = [[] for _ in scripts]
    for r in rows:
        cut[r.i].append(r.script[r.first - 1:r.last])
        assert r.number == len(cut[r.i])
    return cut


def test_spans_cut_the_statements_that_are_split(spark):
    rng = random.Random(3)
    pieces = ["a", ";", " ", "\n", "$", "$$x;$$", "'", "é😀", " ", "`", "\x1c"]
    scripts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(500)]
    # Scripts that both must take: at most one body, which a semicolon closes, and no other mark of one.
    body = "$$x;$$"
    scripts = [s for s in scripts if "$$" not in s.replace(body, "") and "$$$" not in s and s.count(body) <= 1
               and (body not in s or ";" in s.split(body)[1])] + ["", " ;; ", "a;b"]
    assert len(scripts) > 100
    df = spark.createDataFrame(list(enumerate(scripts)), SCHEMA)
    split = [r.s for r in df.select("i", text.split_statements("script").alias("s")).orderBy("i").collect()]
    assert found(spark, scripts) == split


def test_quotes_by_choice(spark):
    scripts = ["a 'x;y' b; c `;`;d", "it ''; 'open; b", "a 'it''s;' ; b $$ ';' ; $$ c; d", None, ""]
    assert found(spark, scripts, True) == [
        ["a 'x;y' b", "c `;`", "d"], ["it ''", "'open; b"], ["a 'it''s;' ", "b $$ ';' ; $$ c", "d"], [], []]
    assert found(spark, scripts[:1]) == [["a 'x", "y' b", "c `", "`", "d"]]


def test_an_open_body_fails(spark):
    df = spark.createDataFrame([(1, "a; $$ b")], SCHEMA)
    with pytest.raises(PySparkException, match="closing tag"):
        spans.statement_spans(df, F.col("script")).collect()
