"""One key holds most of the rows: results stay whole and the work stays spread."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ledger_state as state
from tidemark.operators import changes, skew
from tidemark.operators.skew import join_per_key, join_same, top_per_scope, with_ordinal
from tidemark.plans import steps
from tidemark.session import materialize

from .plans import final, physical


@pytest.fixture(scope="module")
def hot(spark):
    """60% of the rows belong to one scope."""
    return spark.range(0, 20_000, 1, 6).select(
        F.when(F.col("id") % 5 < 3, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("scope"),
        F.format_string("240101_%06d_v", F.pmod(F.col("id") * 7919, F.lit(20_000))).alias("version"),
        (F.col("id") % 1000).alias("apply_time"), F.col("id").alias("seq"),
        F.lit(0).alias("is_deleted"), F.lit(None).cast("string").alias("batch_id"),
    )


@pytest.fixture(scope="module")
def with_nulls(hot):
    """Rows without a scope form a group of their own."""
    return hot.withColumn("scope", F.nullif("scope", F.lit("1")))


def expected_ordinal(df, order):
    return df.withColumn("want", F.row_number().over(Window.partitionBy("scope").orderBy(*order)))


def test_ordinal_of_a_hot_scope(with_nulls):
    order = [F.desc("apply_time"), F.asc("version")]
    got = with_ordinal(with_nulls, order, ["scope"])
    both = join_same(expected_ordinal(with_nulls, order), got.select("scope", "version", "ordinal"), ["scope", "version"])
    assert both.count() == 20_000 and both.filter("want <> ordinal").isEmpty()


def test_ordinal_without_scope(hot):
    got = with_ordinal(hot, [F.asc("version"), F.asc("scope")]).select("ordinal", "version").collect()
    assert sorted(r.ordinal for r in got) == list(range(1, 20_001))
    assert [r.version for r in sorted(got)] == sorted(r.version for r in got)


def test_ordinal_spreads_the_hot_scope(spark, hot, monkeypatch):
    parts = []

    def spy(df, label):
        result = materialize(df, label)
        parts.extend(result.filter("scope = 'hot'").groupBy(F.shiftright("_row", 33)).count().collect())
        return result

    monkeypatch.setattr(skew, "materialize", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with_ordinal(hot, [F.asc("version")], ["scope"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 2 and max(r["count"] for r in parts) < 8_000


@pytest.mark.parametrize("n", [3, 1500, None])
def test_pending_prefix_keeps_every_group(with_nulls, n):
    got = steps.pending_prefix(with_nulls.select("scope", "version"), n)
    totals = {r.scope: r["count"] for r in with_nulls.groupBy("scope").count().collect()}
    assert {r.scope: r.total for r in got.collect()} == totals
    assert got.count() == sum(min(t, n or t) for t in totals.values())


@pytest.mark.parametrize("n", [3, 1500, None])
def test_top_per_scope(hot, n):
    order = [F.desc("apply_time"), F.asc("version")]
    want = expected_ordinal(hot, order)
    want = want if n is None else want.filter(F.col("want") <= n)
    got = top_per_scope(hot, order, ["scope"], n)
    assert sorted((r.scope, r.version, r.want) for r in want.collect()) == sorted(
        (r.scope, r.version, r.ordinal) for r in got.collect())


def test_top_per_scope_limits_before_the_shuffle(hot):
    plan = physical(top_per_scope(hot, [F.asc("version")], ["scope"], 3))
    before = plan[plan.index("Exchange hashpartitioning(scope"):]
    assert "WindowGroupLimit" in before and "Partial" in before


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_per_key(with_nulls, how):
    per_key = with_nulls.filter("scope is null or scope <> '2'").groupBy("scope").agg(F.max("seq").alias("top"))
    got = join_per_key(with_nulls, per_key, ["scope"], ["version"], how)
    want = join_same(with_nulls, per_key, ["scope"], how)
    assert got.filter("scope is null and top is not null").count() > 0
    assert got.filter("scope = '2'").count() == (0 if how == "inner" else with_nulls.filter("scope = '2'").count())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_join_per_key_spreads_the_hot_key(spark, hot, monkeypatch):
    """Rows of the hot scope are joined under many salts, rows of the others under one."""
    salted = []

    def spy(left, right, keys, how="inner"):
        if "_salt" in keys:
            salted.append(left.groupBy("scope").agg(F.count_distinct("_salt").alias("n")).collect())
        return join_same(left, right, keys, how)

    monkeypatch.setattr(skew, "join_same", spy)
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    join_per_key(hot, hot.groupBy("scope").agg(F.max("seq").alias("top")), ["scope"], ["version"])
    [found] = salted
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.scope: r.n for r in found}["hot"] == salts
    assert {r.n for r in found if r.scope != "hot"} == {1}


def test_newest_batch_per_scope(hot):
    done = state.latest(hot)
    got = state.latest_batch_per_scope(done)
    top = {r.scope: r.m for r in done.groupBy("scope").agg(F.max("apply_time").alias("m")).collect()}
    want = [r for r in done.collect() if r.apply_time == top[r.scope]]
    assert sorted(map(str, got.select(done.columns).collect())) == sorted(map(str, want))


def test_redo_of_everything_in_a_hot_scope(hot):
    got = steps.redo_plan(state.applied(hot), None)
    assert got.count() == 40_000
    sizes = {r.scope: (r.low, r.high, r.n) for r in got.groupBy("scope").agg(
        F.min("step").alias("low"), F.max("step").alias("high"), F.count_distinct("step").alias("n")).collect()}
    counts = {r.scope: r["count"] for r in hot.groupBy("scope").count().collect()}
    assert sizes == {s: (1, 2 * n, 2 * n) for s, n in counts.items()}


def test_repeated_versions_combine_before_the_shuffle(spark):
    """All rows share one key; each task sends one row on."""
    log = spark.range(0, 10_000, 1, 4).select(
        F.lit("s").alias("scope"), F.lit("v").alias("version"), F.col("id").alias("apply_time"), F.col("id").alias("seq"),
        F.lit(0).alias("is_deleted"), F.lit(None).cast("string").alias("batch_id"))
    plan = physical(state.latest(log))
    assert plan.count("SortAggregate") + plan.count("HashAggregate") + plan.count("ObjectHashAggregate") == 2
    assert state.latest(log).first().seq == 9_999


def test_plans_avoid_row_products(hot):
    done = state.applied(hot)
    joined = [
        state.latest_batch(done), state.latest_batch_per_scope(done), steps.apply_report(hot, done),
        state.unapplied(hot, done), state.exists(hot, done), steps.pending_prefix(hot, 3),
    ]
    for df in joined:
        plan = final(df)
        assert "CartesianProduct" not in plan
        # Only one-row totals may be combined with other rows without a key.
        for line in plan.splitlines():
            if "BroadcastNestedLoopJoin" in line:
                assert "_total" in line
    assert "LeftAnti" in physical(state.unapplied(hot, done))
    assert "TakeOrderedAndProject" in physical(state.history(done, 5))


def test_one_key_with_most_changes(spark):
    """Every third change hits the same row; each task passes on one change of it."""
    base = spark.range(0, 300).select("id", F.lit("old").alias("v"))
    step = F.col("id")
    key = F.when(step % 3 == 0, 7).otherwise(step % 300)
    rows = spark.range(0, 9_000, 1, 4).select(
        key.alias("id"), F.format_string("v%02d", F.floor(step / 1000)).alias("version"), step.alias("seq"),
        F.lit("update").alias("op"), F.struct(key.alias("id"), F.lit("old").alias("v")).alias("before"),
        F.struct(key.alias("id"), step.cast("string").alias("v")).alias("after"))
    now = changes.apply_changes(base, rows, ["id"])
    assert now.count() == 300
    assert now.filter("id = 7").first().v == "8997", "the last multiple of three"
    assert now.filter("v = 'old'").count() == base.join(rows, "id", "left_anti").count() > 0
    back = changes.revert_changes(now, rows, ["id"])
    assert back.filter("v <> 'old'").isEmpty() and back.count() == 300
