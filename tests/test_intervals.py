"""Validity intervals and reads of many versions, against a replay in plain Python."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.operators.changes import change_schema
from tidemark.operators.skew import with_following, with_latest

TABLE = "id long, v string"


@pytest.mark.parametrize("hot", [0, 400])
def test_neighbours_like_windows(spark, hot):
    """Also for a key that lies in several partitions, next to nulls and keys of one row."""
    rng = random.Random(hot)
    rows = [(rng.choice([None, *range(40)]), i, rng.choice([None, None, i])) for i in range(300)] + [(17, 1000 + i, i if i % 90 == 3 else None) for i in range(hot)]
    df = spark.createDataFrame(rows, "k long, at long, v long").repartition(3)
    over = Window.partitionBy("k").orderBy("at")
    want = df.select("*", F.lead("at").over(over).alias("next"), F.last("v", ignorenulls=True).over(over).alias("newest")).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = with_latest(with_following(df, ["k"], [F.col("at")], F.col("at"), "next"), ["k"], [F.col("at")], F.col("v"), "newest")
        assert sorted(map(str, both.collect())) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert with_latest(df.limit(0), ["k"], [F.col("at")], F.col("v"), "newest").count() == 0


def replay(rows, changes, stamp):
    state = dict(rows)
    for key, version, seq, op, after in sorted(changes, key=lambda c: (c[1], c[2])):
        if version[:13] <= stamp[:13]:
            state.pop(key, None)
            if op != "delete":
                state[key] = after
    return state


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    rows = [(i, f"base{i}") for i in range(60)]
    stamps = [f"2401{d:02d}_000000" for d in range(1, 29)]
    changes = [(rng.randrange(80), rng.choice(stamps) + f"_{rng.choice('ab')}", seq, rng.choice(["insert", "update", "delete"]), f"c{seq}") for seq in range(250)]
    changes += [(7, rng.choice(stamps) + "_hot", 1000 + seq, rng.choice(["update", "delete"]), f"h{seq}") for seq in range(300)]
    # In one version the last change of a key counts: by version, then number.
    table = spark.createDataFrame(rows, TABLE)
    frame = spark.createDataFrame([(k, v, s, op, None, None if op == "delete" else (k, a)) for k, v, s, op, a in changes],
                                  change_schema(table.schema, ["id"]))
    return rows, changes, table, frame, stamps


def test_one_version_per_row(spark, case):
    rows, changes, table, frame, stamps = case
    rng = random.Random(5)
    asked = [(rng.randrange(85), rng.choice([*stamps, "231231", "249999", "240110_120000_x"]), i % 3) for i in range(600)]
    asked += [(7, s, 9) for s in stamps for _ in range(10)]
    df = spark.createDataFrame(asked, "id long, as_of string, extra int")
    got = sorted(tuple(r) for r in intervals.rows_as_of_many(table, frame, ["id"], df).select("id", "as_of", "extra", "v").collect())
    states = {s: replay(rows, changes, s) for _, s, _ in asked}
    assert got == sorted((k, s, e, states[s][k]) for k, s, e in asked if k in states[s])
    assert intervals.rows_as_of_many(table, frame, ["id"], df.limit(0)).count() == 0


def test_whole_table_per_version(spark, case):
    rows, changes, table, frame, stamps = case
    asked = ["230101_000000", *stamps[::3], "240109_120000_x", "249999_000000"]
    versions = spark.createDataFrame([(s,) for s in [*asked, asked[1], None]], "as_of string")
    got = sorted(tuple(r) for r in intervals.table_as_of_versions(table, frame, ["id"], versions).collect())
    assert got == sorted((s, k, v) for s in asked for k, v in replay(rows, changes, s).items())
    assert intervals.table_as_of_versions(table, frame, ["id"], versions.limit(0)).count() == 0
    assert sorted(tuple(r)[1:] for r in intervals.table_as_of_versions(table, frame.limit(0), ["id"], versions.limit(1)).collect()) == sorted(rows)


def test_intervals_meet(spark, case):
    rows, changes, table, frame, stamps = case
    got = intervals.validity_intervals(table, frame, ["id"]).collect()
    for stamp in ["231231_000000", *stamps]:
        held = {r.id: r.image.v for r in got if (r.from_version or "") <= stamp and (r.to_version is None or stamp < r.to_version)}
        assert held == replay(rows, changes, stamp)
        assert len(held) == sum((r.from_version or "") <= stamp and (r.to_version is None or stamp < r.to_version) for r in got)


def test_a_missing_image_is_refused(spark, case):
    table = case[2]
    odd = spark.createDataFrame([(1, "240101_000000", 1, "update", None, None)], change_schema(table.schema, ["id"]))
    with pytest.raises(Exception, match="no image after"):
        intervals.validity_intervals(table, odd, ["id"]).collect()
