"""What the ledger says: latest state, pending work, newest batch, counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import top_per_scope

KEY = ("scope", "version")

# Fixed value: the row that marks an initialised ledger. It is never applied or reverted.
BASE_VERSION = "000000_000000_base"

DEFAULT_HISTORY = 10


def without_base(df: DataFrame) -> DataFrame:
    return df.filter(F.col("version") != BASE_VERSION)


def guard_reserved(df: DataFrame) -> DataFrame:
    """Fail the job when a change set names the reserved base row."""
    message = F.concat(F.lit("version is reserved: "), F.col("version"))
    checked = F.when(F.col("version") == BASE_VERSION, F.raise_error(message)).otherwise(F.col("version"))
    return df.withColumn("version", checked)


def latest(log: DataFrame) -> DataFrame:
    """Newest state of each (scope, version), tombstones included.

    The greatest (apply_time, seq) wins over the whole log. Partial aggregation leaves one
    row per key and map task, so a key with very many rows does not load one reducer.
    """
    state = F.max(F.struct("apply_time", "seq", "is_deleted", "batch_id")).alias("state")
    return log.groupBy(*KEY).agg(state).select(*KEY, "state.*")


def applied(log: DataFrame) -> DataFrame:
    return latest(log).filter("is_deleted = 0")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left`` joined to ``right`` on keys of which NULL equals NULL, as it does in :func:`latest`."""
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_of_{k}" for k in keys])


def pending(defined: DataFrame, done: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Defined rows whose key has not been applied, in ascending key order."""
    return unapplied(defined, done, keys).orderBy(*keys)


def unapplied(defined: DataFrame, done: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """As :func:`pending` without the order, for plans that sort or aggregate later."""
    return join_keys(defined, done.select(*keys).distinct(), keys, "left_anti")


def exists(asked: DataFrame, done: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """For each asked key: how often it was asked and whether it is applied."""
    per_key = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_asked"))
    present = done.select(*keys).distinct().withColumn("is_applied", F.lit(True))
    return join_keys(per_key, present, keys, "left").withColumn(
        "is_applied", F.coalesce("is_applied", F.lit(False))
    )


def missing_counterparts(batch: DataFrame, counterparts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the batch that have no counterpart. Both sides shrink to distinct keys first."""
    return batch.select(*keys).distinct().join(
        counterparts.select(*keys).distinct(), list(keys), "left_anti"
    )


def latest_batch(done: DataFrame) -> DataFrame:
    """Rows that share the greatest apply time, newest version first."""
    newest = done.agg(F.max("apply_time").alias("_newest"))
    return (
        done.crossJoin(F.broadcast(newest))
        .filter("apply_time = _newest")
        .drop("_newest")
        .orderBy(F.desc("version"), "scope")
    )


def latest_batch_per_scope(done: DataFrame) -> DataFrame:
    """Rows that share the greatest apply time of their scope. The time spreads a hot scope over the join."""
    newest = done.groupBy("scope").agg(F.max("apply_time").alias("apply_time")).filter("apply_time IS NOT NULL")
    return join_keys(done, newest, ("scope", "apply_time"), "left_semi")


def count_applied(done: DataFrame) -> DataFrame:
    return done.groupBy("scope").agg(F.count(F.lit(1)).alias("n_applied"))


def history(done: DataFrame, n: int | None = DEFAULT_HISTORY) -> DataFrame:
    """Newest applied rows first. The base row is removed before the limit."""
    ordered = without_base(done).orderBy(F.desc("apply_time"), F.desc("version"), "scope")
    return ordered if n is None else ordered.limit(n)


def history_by_version(done: DataFrame, n: int | None = DEFAULT_HISTORY) -> DataFrame:
    ordered = without_base(done).orderBy(F.desc("version"), "scope")
    return ordered if n is None else ordered.limit(n)


def history_per_scope(done: DataFrame, n: int | None = DEFAULT_HISTORY) -> DataFrame:
    return top_per_scope(
        without_base(done), [F.desc("apply_time"), F.desc("version")], ["scope"], n
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count. Empty means the table may be published."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
