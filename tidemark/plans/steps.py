"""Ordered plans over the ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import version_key
from ..operators.ledger_state import KEY, join_keys, unapplied, without_base
from ..operators.skew import join_per_key, join_same, top_per_scope, with_ordinal


def pending_prefix(todo: DataFrame, n: int | None, scope: Sequence[str] = ("scope",),
                   order: Sequence[str] = ("version",)) -> DataFrame:
    """The first ``n`` pending rows of each scope, their position and the total: "n out of total"."""
    totals = todo.groupBy(*scope).agg(F.count(F.lit(1)).alias("total"))
    first = top_per_scope(todo, [F.col(c) for c in order], scope, n, "step")
    if n is None:
        return join_per_key(first, totals, scope, order)
    return join_same(first, totals, scope)


def redo_plan(done: DataFrame, n: int | None = 1) -> DataFrame:
    """Revert the newest ``n`` rows of each scope newest first, then apply them oldest first."""
    order = [F.desc("apply_time"), F.desc("version")]
    newest = top_per_scope(without_base(done).select(*KEY, "apply_time"), order, ["scope"], n, "_back")
    if n is None:
        sizes = newest.groupBy("scope").agg(F.count(F.lit(1)).alias("_size"))
        sized = join_per_key(newest, sizes, ["scope"], ["version"])
    else:
        sized = newest.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("scope")))
    both = F.array(
        F.struct(F.lit("revert").alias("direction"), F.col("_back").alias("step")),
        F.struct(F.lit("apply").alias("direction"), (2 * F.col("_size") - F.col("_back") + 1).alias("step")),
    )
    return sized.select(*KEY, F.inline(both))


def plan_to(defined: DataFrame, done: DataFrame, target: str, numbered: bool = True) -> DataFrame:
    """The way to one target stamp for a whole ledger, as numbered steps or just in order.

    When the target is applied, everything later is reverted, newest first; otherwise the
    pending rows up to the target are applied in ascending order.
    """
    at_target = without_base(done).filter(version_key("version") == target).limit(1)
    flag = F.broadcast(at_target.agg((F.count(F.lit(1)) > 0).alias("_down")))
    reverts = (
        without_base(done).filter(version_key("version") > target)
        .crossJoin(flag).filter("_down")
        .select(*KEY, F.lit("revert").alias("direction"), "apply_time")
    )
    applies = (
        unapplied(without_base(defined), done).filter(version_key("version") <= target)
        .crossJoin(flag).filter("not _down")
        .select(*KEY, F.lit("apply").alias("direction"), F.lit(None).cast("bigint").alias("apply_time"))
    )
    is_revert = F.col("direction") == "revert"
    order = [
        F.desc_nulls_last("apply_time"),
        F.when(is_revert, F.col("version")).desc(),
        F.when(~is_revert, F.col("version")).asc(),
        F.col("scope").asc(),
    ]
    plan = reverts.unionByName(applies)
    return (with_ordinal(plan, order, name="step") if numbered else plan.orderBy(*order)).drop("apply_time")


def plan_to_per_scope(defined: DataFrame, done: DataFrame, target: str) -> DataFrame:
    """As :func:`plan_to`, decided for each scope of a fleet."""
    at_target = (
        without_base(done).groupBy("scope")
        .agg(F.max(version_key("version") == target).alias("_down"))
    )
    reverts = join_per_key(
        without_base(done).filter(version_key("version") > target).select(*KEY),
        at_target, ["scope"], ["version"],
    ).filter("_down").select(*KEY, F.lit("revert").alias("direction"))
    todo = unapplied(without_base(defined), done).filter(version_key("version") <= target).select(*KEY)
    applies = join_per_key(todo, at_target, ["scope"], ["version"], "left").filter(
        ~F.coalesce("_down", F.lit(False))
    ).select(*KEY, F.lit("apply").alias("direction"))
    return reverts.unionByName(applies)


def apply_report(planned: DataFrame, done: DataFrame) -> DataFrame:
    """How far a plan got in each scope: steps applied, steps cancelled, steps in all."""
    present = done.select(*KEY).distinct().withColumn("_present", F.lit(1))
    return (
        join_keys(planned.select(*KEY), present, KEY, "left")
        .groupBy("scope")
        .agg(
            F.count("_present").alias("n_applied"),
            (F.count(F.lit(1)) - F.count("_present")).alias("n_cancelled"),
            F.count(F.lit(1)).alias("n_planned"),
        )
    )


def dry_run(defined: DataFrame, done: DataFrame | None) -> DataFrame:
    """What an upgrade would apply, per scope. A ledger that does not exist yet counts as empty."""
    todo = without_base(defined).select(*KEY)
    if done is not None:
        todo = unapplied(todo, done)
    return todo.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_planned"),
        F.min("version").alias("first_version"),
        F.max("version").alias("last_version"),
    )
