"""Applying and reverting change sets, and publishing batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as ops
from ..operators import intervals, ledger_state, patches
from ..session import table, workspace
from ..sources.batches import LEDGER, AlreadyApplied, BatchStore
from ..sources.changelog import ChangeLog, TrackedTable
from . import register
from .inputs import order_changes, orders_after_sql

_KEY = ["o_orderkey"]


@register(orders_after_sql(3))
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.apply_changes(table(spark, sf_dir, "orders"), order_changes(spark, sf_dir), _KEY)


@register(orders_after_sql(0))
def revert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = order_changes(spark, sf_dir)
    return ops.revert_changes(ops.apply_changes(table(spark, sf_dir, "orders"), changes, _KEY), changes, _KEY)


@register(orders_after_sql(2))
def table_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.table_as_of(table(spark, sf_dir, "orders"), order_changes(spark, sf_dir), _KEY, "240102_000000")


@register(orders_after_sql(1))
def revert_to_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = order_changes(spark, sf_dir)
    now = ops.apply_changes(table(spark, sf_dir, "orders"), changes, _KEY)
    return ops.revert_changes(now, ops.after(changes, "240101_000000"), _KEY)


@register(orders_after_sql(3))
def redo_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = order_changes(spark, sf_dir)
    return ops.redo(ops.apply_changes(table(spark, sf_dir, "orders"), changes, _KEY), changes, _KEY, 2)


def _patches_sql(select: str) -> str:
    """Lines as patches of their orders: the first names the price, the second date and priority, the third a price that is null."""
    return f"""WITH p AS (
  SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber % 3 AS kind, max(l_extendedprice) AS l_extendedprice,
    max(l_shipdate) AS l_shipdate, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber),
last AS (
  SELECT k, arg_max({{'v': CASE kind WHEN 1 THEN l_extendedprice END}}, n) FILTER (kind <> 2) AS price,
    arg_max({{'v': l_shipdate}}, n) FILTER (kind = 2) AS day, arg_max({{'v': l_returnflag}}, n) FILTER (kind = 2) AS flag,
    arg_max({{'v': CASE kind WHEN 1 THEN l_extendedprice END}}, n) FILTER (kind <> 2 AND n < 4) AS early_price,
    arg_max({{'v': l_shipdate}}, n) FILTER (kind = 2 AND n < 4) AS early_day,
    arg_max({{'v': l_returnflag}}, n) FILTER (kind = 2 AND n < 4) AS early_flag FROM p GROUP BY k)
SELECT o_orderkey, o_custkey, o_orderstatus, {select} FROM orders LEFT JOIN last ON o_orderkey = k"""


def _order_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    nothing = F.lit(None)
    # Some lines of an order have the same number; together they are one patch.
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.max(c).alias(c) for c in ("l_extendedprice", "l_shipdate", "l_returnflag")])
    return lines.select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("24010"), "l_linenumber", F.lit("_000000")).alias("version"),
        F.col("l_linenumber").cast("long").alias("seq"),
        F.when(kind == 2, F.array(F.lit("o_orderdate"), F.lit("o_orderpriority"))).otherwise(F.array(F.lit("o_totalprice"))).alias("named"),
        F.struct(nothing.cast("bigint").alias("o_custkey"), nothing.cast("string").alias("o_orderstatus"),
                 F.when(kind == 1, F.col("l_extendedprice")).alias("o_totalprice"), F.col("l_shipdate").alias("o_orderdate"),
                 F.col("l_returnflag").alias("o_orderpriority")).alias("after"))


@register(_patches_sql("""CASE WHEN price IS NULL THEN o_totalprice ELSE price.v END AS o_totalprice,
  CASE WHEN day IS NULL THEN o_orderdate ELSE day.v END AS o_orderdate,
  CASE WHEN flag IS NULL THEN o_orderpriority ELSE flag.v END AS o_orderpriority"""))
def apply_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.apply_patches(table(spark, sf_dir, "orders"), _order_patches(spark, sf_dir), _KEY)


@register(_patches_sql("""CASE WHEN early_price IS NULL THEN o_totalprice ELSE early_price.v END AS o_totalprice,
  CASE WHEN early_day IS NULL THEN o_orderdate ELSE early_day.v END AS o_orderdate,
  CASE WHEN early_flag IS NULL THEN o_orderpriority ELSE early_flag.v END AS o_orderpriority"""))
def revert_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patches applied and recorded, then those from the fourth version on taken back."""
    orders, given = table(spark, sf_dir, "orders"), _order_patches(spark, sf_dir)
    recorded = patches.with_before(orders, given, _KEY)
    return patches.revert_patches(patches.apply_patches(orders, given, _KEY), ops.after(recorded, "240103_000000"), _KEY)


@register("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_state.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a batch per day."""
    return table(spark, sf_dir, "events").withColumn("batch_id", F.date_format("ts", "'b'yyyyMMdd"))


def _version(day: str = "ts") -> Column:
    return F.concat(F.date_format(day, "yyMMdd"), F.lit("_000000_load"))


def _published(spark: SparkSession, sf_dir: str) -> BatchStore:
    """Days before the 20th as one batch each, the 20th to the 24th as one release, the rest only staged."""
    store = BatchStore(spark, workspace(spark, "batches"))
    days = _daily(spark, sf_dir)
    single = days.filter("batch_id < 'b20240120' or batch_id >= 'b20240125'")
    store.stage_many("purchases", single.filter("event_type = 'purchase'"))
    store.stage_many("others", single.filter("event_type <> 'purchase'"))
    store.stage_many(LEDGER, single.select(
        F.lit("events").alias("scope"), _version().alias("version"),
        F.unix_seconds(F.date_trunc("day", "ts")).alias("apply_time"),
        F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("is_deleted"), "batch_id").distinct())
    # One id per day: a short list, as the commit file names every batch.
    ids = store.staged(LEDGER, days.schema).select("batch_id").distinct().filter("batch_id < 'b20240120'")
    store.commit(sorted(r.batch_id for r in ids.collect()), 1000)
    late = days.filter("batch_id >= 'b20240120' and batch_id < 'b20240125'").drop("batch_id")
    store.release(
        late.select(F.lit("events").alias("scope"), _version().alias("version")).distinct(),
        {"purchases": late.filter("event_type = 'purchase'"), "others": late.filter("event_type <> 'purchase'")},
        {"purchases": ["event_id"], "others": ["event_id"]}, apply_time=2000,
    )
    return store


def _visible(store: BatchStore, schema) -> DataFrame:
    """Per table and day: rows that readers see."""
    both = store.read("purchases", schema).withColumn("table_name", F.lit("purchases")).unionByName(
        store.read("others", schema).withColumn("table_name", F.lit("others")))
    return both.groupBy("table_name", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


_VISIBLE_SQL = """SELECT CASE WHEN event_type = 'purchase' THEN 'purchases' ELSE 'others' END AS table_name,
  CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
FROM events WHERE ts < TIMESTAMP '{until} 00:00:00' GROUP BY ALL"""


@register(_VISIBLE_SQL.format(until="2024-01-25"))
def release_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(_published(spark, sf_dir), table(spark, sf_dir, "events").schema)


@register(_VISIBLE_SQL.format(until="2024-01-20"))
def rollback_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _published(spark, sf_dir)
    store.rollback(counterparts=table(spark, sf_dir, "events").select(
        F.lit("events").alias("scope"), _version().alias("version")))
    return _visible(store, table(spark, sf_dir, "events").schema)


@register("""SELECT DISTINCT 'events' AS scope, strftime(ts, '%y%m%d') || '_000000_load' AS version,
  CASE WHEN ts < TIMESTAMP '2024-01-20' THEN epoch_us(date_trunc('day', ts)) // 1000000 ELSE 2000 END AS apply_time
FROM events WHERE ts < TIMESTAMP '2024-01-25 00:00:00'""")
def release_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).applied().select("scope", "version", "apply_time")


@register("""SELECT event_id, ts, user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'""")
def best_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weekly versions of which the third repeats keys of the first: two stay applied."""
    store = BatchStore(spark, workspace(spark, "effort"))
    events = table(spark, sf_dir, "events")
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 7), F.lit(3))
    weekly = events.withColumn("batch_id", F.concat(F.lit("w"), week))
    store.stage_many("events", weekly)
    store.stage_many("events", weekly.filter("batch_id = 'w0'").withColumn("batch_id", F.lit("w2")))
    done, refused = store.apply_each(["w0", "w1", "w2", "w3"], "events", events.schema, ["event_id"], 1000)
    if done != ["w0", "w1"] or refused is None:
        raise RuntimeError("the third version must be refused")
    return store.read("events", events.schema).select("event_id", "ts", "user_id", "event_type")


@register("SELECT event_id, ts, user_id, event_type FROM events")
def idempotent_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applying twice equals once: the second apply is refused, or skipped when not strict."""
    store = BatchStore(spark, workspace(spark, "twice"))
    events = table(spark, sf_dir, "events")
    versions = events.select(F.lit("events").alias("scope"), _version().alias("version")).distinct()
    store.release(versions, {"events": events}, apply_time=1000, batch_id="b1")
    if store.commit(["b1"], 2000, strict=False):
        raise RuntimeError("an applied batch must be skipped")
    try:
        store.release(versions, {"events": events}, apply_time=3000)
    except AlreadyApplied:
        return store.read("events", events.schema).select("event_id", "ts", "user_id", "event_type")
    raise RuntimeError("an applied version must be refused")


def _order_log(spark: SparkSession, sf_dir: str) -> ChangeLog:
    """``orders`` with its three versions staged and none applied."""
    changes = order_changes(spark, sf_dir)
    log = ChangeLog(
        BatchStore(spark, workspace(spark, "changelog")),
        {"orders": TrackedTable(table(spark, sf_dir, "orders"), _KEY)}, scope="orders",
    )
    for version in ("240101_000000_raise", "240102_000000_close", "240103_000000_copy"):
        log.add(version, {"orders": changes.filter(F.col("version") == version)})
    return log


@register(orders_after_sql(2))
def upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _order_log(spark, sf_dir)
    log.up(2, apply_time=1000)
    return log.rows("orders")


@register(orders_after_sql(1))
def downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _order_log(spark, sf_dir)
    log.up(apply_time=1000)
    log.down(2)
    return log.rows("orders")


@register(orders_after_sql(2))
def migrate_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward to a time between two versions, then to the last one, then back to the second."""
    log = _order_log(spark, sf_dir)
    for target in ("2024-01-01 12:00:00", "240103_000000", "240102_000000_close"):
        log.to(target, apply_time=1000)
    return log.rows("orders")


@register(orders_after_sql(3))
def redo_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _order_log(spark, sf_dir)
    log.up(apply_time=1000)
    log.redo(2, apply_time=2000)
    return log.rows("orders")


@register(orders_after_sql(1))
def release_and_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version alone, the other two as one release, which is then rolled back."""
    log = _order_log(spark, sf_dir)
    log.up(1, apply_time=1000)
    log.release(apply_time=2000)
    log.rollback()
    return log.rows("orders")


@register(orders_after_sql(3))
def fold_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions folded into the base, the third merged on top."""
    log = _order_log(spark, sf_dir)
    log.up(apply_time=1000)
    log.fold()
    return log.rows("orders")


@register(orders_after_sql(1))
def revert_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions are reverted after they were folded."""
    log = _order_log(spark, sf_dir)
    log.up(1, apply_time=1000)
    log.fold("240101_000000")
    log.up(apply_time=2000)
    log.fold("240103_000000")
    log.down(2)
    return log.rows("orders")


_STAMPS = ("231231_000000", "240101_000000", "240102_120000", "240199_000000")


@register(" UNION ALL ".join(
    f"SELECT '{stamp}' AS as_of, * FROM ({orders_after_sql(n)})" for n, stamp in enumerate(_STAMPS)))
def table_as_of_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = spark.createDataFrame([(s,) for s in _STAMPS], "as_of string")
    return intervals.table_as_of_versions(table(spark, sf_dir, "orders"), order_changes(spark, sf_dir), _KEY, versions)


# Every line item asks for its order as of a version of its own; those of two thirds ask for an order copied later.
@register(" UNION ALL ".join(f"""
SELECT l.l_partkey, '{stamp}' AS as_of, o.* FROM lineitem l JOIN ({orders_after_sql(n)}) o
  ON o.o_orderkey = l.l_orderkey + CASE WHEN l.l_linenumber % 3 > 0 AND l.l_orderkey % 10 = 2 THEN 1000000000 ELSE 0 END
WHERE l.l_partkey % 4 = {n}""" for n, stamp in enumerate(_STAMPS)))
def rows_as_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when((F.col("l_linenumber") % 3 > 0) & (F.col("l_orderkey") % 10 == 2), 1_000_000_000).otherwise(0)
    stamp = F.element_at(F.array(*map(F.lit, _STAMPS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + moved).alias("o_orderkey"), "l_partkey", stamp.alias("as_of"))
    return intervals.rows_as_of_many(table(spark, sf_dir, "orders"), order_changes(spark, sf_dir), _KEY, asked)


@register("""WITH held AS (
  SELECT o_orderkey, unnest([NULL, '240101_000000', '240102_000000', '240103_000000']) AS from_version, generate_subscripts([1, 2, 3, 4], 1) - 1 AS n FROM orders)
SELECT h.o_orderkey, h.from_version,
  CASE WHEN h.o_orderkey % 10 = 0 AND n = 0 THEN '240101_000000' WHEN h.o_orderkey % 20 = 0 AND n = 1 THEN '240102_000000'
    WHEN h.o_orderkey % 10 = 1 AND n = 0 THEN '240102_000000' END AS to_version
FROM held h WHERE n = 0 OR (n = 1 AND h.o_orderkey % 10 = 0) OR (n = 2 AND h.o_orderkey % 20 = 0) OR (n = 3 AND h.o_orderkey % 100 = 31)
UNION ALL SELECT o_orderkey + 1000000000, '240103_000000', NULL FROM orders WHERE o_orderkey % 10 = 2""")
def validity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.validity_intervals(table(spark, sf_dir, "orders"), order_changes(spark, sf_dir), _KEY).drop("image")
