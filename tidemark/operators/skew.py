"""Numbering and joining rows when one key may hold a large share of the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Spark keeps at most this many rows per group and map task before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold); larger limits use with_ordinal.
GROUP_LIMIT = 1000

# A key is hot when it holds more than one in HOT_SHARE rows, so there are fewer hot keys than that.
HOT_SHARE = 1000


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL, as it does in a grouping."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def with_ordinal(df: DataFrame, order: Sequence[Column], scope: Sequence[str] = (),
                 name: str = "ordinal") -> DataFrame:
    """Add the 1-based position of each row within its scope.

    ``order`` has to be total within a scope. A window over the scope would sort a hot
    scope in one task; here the rows are range-partitioned by (scope, order), so a hot
    scope spreads over many partitions, and only per-partition counts are summed up.
    """
    by = [F.col(c) for c in scope] + list(order)
    placed = materialize(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ordinal",
    ).withColumn("_part", F.shiftright("_row", 33))
    group = [*scope, "_part"]
    counts = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        join_same(placed, offsets, group)
        .withColumn(name, F.col("_before") + F.col("_row") - F.col("_first") + 1)
        .drop("_row", "_part", "_first", "_before")
    )


def top_per_scope(df: DataFrame, order: Sequence[Column], scope: Sequence[str], n: int | None,
                  name: str = "ordinal") -> DataFrame:
    """The first ``n`` rows of each scope with their position; ``None`` keeps all rows."""
    if n is not None and n < 1:
        raise ValueError("n must be at least 1")
    if n is not None and n <= GROUP_LIMIT:
        position = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
        return df.withColumn(name, position.cast("bigint")).filter(F.col(name) <= n)
    numbered = with_ordinal(df, order, scope, name)
    return numbered if n is None else numbered.filter(F.col(name) <= n)


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str],
                 spread_by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join every row to the one ``per_key`` row of its key, splitting hot keys.

    Rows of a hot key are spread by the hash of ``spread_by``, and only the hot keys are
    repeated on the other side. Fewer than ``HOT_SHARE`` keys can be hot, which bounds the
    broadcast whatever the size of the table.
    """
    salts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = sizes.agg(F.sum("_rows").alias("_total"))
    hot = F.broadcast(
        sizes.crossJoin(F.broadcast(total))
        .filter(F.col("_rows") * HOT_SHARE > F.col("_total"))
        .select(*keys, F.lit(True).alias("_hot"))
    )
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    left = join_same(rows, hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))
    ).drop("_hot")
    right = join_same(per_key, hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return join_same(left, right, [*keys, "_salt"], how).drop("_salt")


def _in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` written in the order of (keys, order), with ``_part`` and ``_row``.

    A key that lies in several parts is the last key of all of them but the last, and the first of all but the first.
    """
    by = [F.col(k) for k in keys] + list(order)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    return materialize(placed, "parts").withColumn("_part", F.shiftright("_row", 33))


def _key_of(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def with_following(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``value`` of the next row of the same key, null for the last one.

    As a window with ``lead`` would, but a key may have any share of the rows: they are range-partitioned by (keys, order),
    and only one row per partition is looked at to go on from one to the next. ``order`` has to be total within a key.
    """
    placed = _in_parts(df.withColumn("_value", F.struct(value.alias("v"))), keys, order)
    edges = placed.groupBy("_part").agg(F.min_by(F.struct(_key_of(keys).alias("k"), "_value"), "_row").alias("_first"),
                                        F.max_by(_key_of(keys), "_row").alias("_key"))
    after = F.lead("_first").over(Window.orderBy("_part"))
    edges = edges.select("_part", "_key", after.alias("_next")).filter(F.col("_key").eqNullSafe(F.col("_next.k")))
    inside = F.lead("_value").over(Window.partitionBy("_part", *keys).orderBy("_row"))
    edges = edges.select("_part", "_key.*", F.col("_next._value").alias("_edge"))
    joined = join_same(placed.withColumn("_inside", inside), edges, ["_part", *keys], "left")
    return joined.withColumn(name, F.coalesce("_inside", "_edge")["v"]).drop("_value", "_inside", "_edge", "_row", "_part")


def with_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add the newest ``value`` that is not null, up to and including each row of the same key: an as-of join by one sort.

    Like :func:`with_following`, no task holds a key as a whole. ``order`` has to be total within a key.
    """
    return _with_carried(df, keys, order, {name: value}, Window.currentRow)


def with_earlier(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Mapping[str, Column]) -> DataFrame:
    """Add, of each of ``values`` by name, the newest that is not null among the rows before each row of the same key.

    One sort for all of them, as in :func:`with_latest`. ``order`` has to be total within a key.
    """
    return _with_carried(df, keys, order, values, -1)


def _with_carried(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Mapping[str, Column], upto: int) -> DataFrame:
    held = {name: f"_value_{i}" for i, name in enumerate(values)}
    # Values follow from the written columns: they need not be written too.
    placed = _in_parts(df, keys, order).withColumns({held[n]: v for n, v in values.items()})
    rows = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, upto)
    ends = placed.groupBy("_part").agg(F.min_by(_key_of(keys), "_row").alias("_start"), F.max_by(_key_of(keys), "_row").alias("_key"))
    # A part gives the newest values of its last key; a later part that begins with that key takes them.
    lasts = join_same(placed.select("_part", "_row", *keys, *held.values()), ends.select("_part", "_key.*"), ["_part", *keys], "left_semi")
    newest = lasts.groupBy("_part").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_row"))).alias(v) for v in held.values()])
    gives = ends.join(newest, "_part").select("_part", "_key", F.lit(1).alias("_turn"), *held.values())
    takes = ends.select("_part", F.col("_start").alias("_key"), F.lit(0).alias("_turn"))
    before = Window.partitionBy("_key").orderBy("_part", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = gives.unionByName(takes, allowMissingColumns=True).select(
        "_part", "_key", "_turn", *[F.last(v, ignorenulls=True).over(before).alias(f"_edge{v}") for v in held.values()])
    edges = carried.filter("_turn = 0").select("_part", "_key.*", *[f"_edge{v}" for v in held.values()])
    inside = placed.withColumns({f"_inside{v}": F.last(v, ignorenulls=True).over(rows) for v in held.values()}).drop(*held.values())
    joined = join_same(inside, edges, ["_part", *keys], "left")
    return joined.withColumns({n: F.coalesce(f"_inside{v}", f"_edge{v}") for n, v in held.items()}).drop(
        *[f"{at}{v}" for v in held.values() for at in ("_inside", "_edge")], "_row", "_part")
