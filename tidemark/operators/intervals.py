"""Rows with the versions between which they hold, and reads of many versions at once.

A change set is the one of ``operators.changes``. A row holds from the version that put it there to before the version that
changed or deleted it; only the stamp of a version counts, its first 13 characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import version_key
from ..session import materialize
from .skew import join_per_key, join_same, with_following, with_latest, with_ordinal


def _starts(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, at, gone, image): what each key is from each of its versions on; ``at`` is empty for the rows of the table.

    Of several changes of a key in one version the last counts. The image of a change that sets a row must not be missing.
    """
    own = F.struct(*[F.col(c) for c in table.columns])
    base = table.select(*keys, F.lit("").alias("at"), F.lit(False).alias("gone"), own.alias("image"))
    last = changes.withColumn("at", version_key("version")).groupBy(*keys, "at").agg(
        F.max_by(F.struct("op", "after"), F.struct("version", "seq")).alias("last"))
    gone = F.col("last.op") == "delete"
    message = F.concat(F.lit("no image after the "), F.col("last.op"), F.lit(" of a row"))
    image = F.when(gone | F.col("last.after").isNotNull(), F.col("last.after")).otherwise(F.raise_error(message).cast(table.schema))
    return base.unionByName(last.select(*keys, "at", gone.alias("gone"), image.alias("image")))


def validity_intervals(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, from_version, to_version, image): every state of every row, ``from_version`` <= v < ``to_version``.

    Null for the first means that the row was in the table before all changes, null for the second that it is still there. Keys
    are unique in the table. A deleted key has no row until it is inserted again. A hot key's changes spread over partitions.
    """
    starts = _starts(table, changes, keys)
    spans = with_following(starts, keys, [F.col("at")], F.col("at"), "to_version").filter("not gone")
    return spans.select(*keys, F.nullif("at", F.lit("")).alias("from_version"), "to_version", "image")


def rows_as_of_many(table: DataFrame, changes: DataFrame, keys: Sequence[str], asked: DataFrame) -> DataFrame:
    """The rows of the keys asked for, each as of its own version: the columns of ``asked``, then those of the table but the keys.

    ``asked`` has the keys and ``as_of``, and may have more columns; a key may be asked for any number of versions, and asks
    that are equal in all columns get a row each. Asks for a row that is not there then get none. Only asked keys are read on; one sort brings
    asks and changes together, and the newest change is carried to the asks behind it, so a key with many changes and many
    asks costs their sum and not their product.
    """
    wanted = asked.select(*keys).distinct()
    starts = _starts(join_same(table, wanted, keys, "left_semi"), join_same(changes, wanted, keys, "left_semi"), keys)
    ask = F.struct(*[F.col(c) for c in asked.columns])
    asks = asked.select(*keys, version_key("as_of").alias("at"), ask.alias("ask"))
    merged = starts.select(*keys, "at", F.struct("gone", "image").alias("now"), F.lit(0).alias("turn")).unionByName(
        asks.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    order = [F.col("at"), F.col("turn"), F.xxhash64("ask")]
    found = with_latest(merged, keys, order, F.col("now"), "state").filter("ask is not null and not state.gone")
    rest = [F.col(f"state.image.{c}").alias(c) for c in table.columns if c not in keys]
    return found.select("ask.*", *rest)


def table_as_of_versions(table: DataFrame, changes: DataFrame, keys: Sequence[str], versions: DataFrame) -> DataFrame:
    """``as_of`` and the columns of the table: the whole table as of each of the ``versions`` (as_of), in one pass.

    Asked versions are numbered; the ends of an interval become numbers by an as-of join, and a state is repeated for
    the asked versions between them. So the work is that of the result.
    """
    intervals = materialize(validity_intervals(table, changes, keys), "intervals")
    asks = versions.select("as_of").distinct().filter("as_of is not null").select(F.lit(0).alias("one"), version_key("as_of").alias("at"), "as_of")
    # The number of an asked version among all, and of asked versions before each stamp.
    # Written, so that its size is known: a short list is broadcast below, and in a long one no rank is hot.
    numbered = materialize(with_ordinal(asks, [F.col("at"), F.col("as_of")], name="rank"), "asked")
    stamps = intervals.select(F.col("from_version").alias("at")).union(intervals.select("to_version")).distinct().filter("at is not null")
    merged = numbered.select("one", "at", F.lit(1).alias("turn"), F.col("rank").alias("tie"), "rank").unionByName(
        stamps.select(F.lit(0).alias("one"), "at", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("tie")), allowMissingColumns=True)
    before = with_latest(merged, ["one"], [F.col("at"), F.col("turn"), F.col("tie")], F.col("rank"), "n_before").filter("turn = 0")
    before = before.select("at", F.coalesce("n_before", F.lit(0)).alias("n"))
    low = before.select(F.col("at").alias("from_version"), F.col("n").alias("low"))
    high = before.select(F.col("at").alias("to_version"), F.col("n").alias("high"))
    many = numbered.groupBy().agg(F.count("*").alias("n_asked"))
    # Many rows share a version, and most share the null of rows that never changed.
    spans = join_per_key(join_per_key(intervals, low, ["from_version"], keys, "left"), high, ["to_version"], keys, "left")
    spans = spans.crossJoin(F.broadcast(many))
    first, last = F.coalesce("low", F.lit(0)) + 1, F.coalesce("high", "n_asked")
    repeated = spans.filter(first <= last).select(F.explode(F.sequence(first, last)).alias("rank"), "image")
    return repeated.join(numbered.select("rank", "as_of"), "rank").select("as_of", "image.*")

