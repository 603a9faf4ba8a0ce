"""Ledgers, plans and change sets made from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, workspace
from ..sources.ledger import Ledger

JOB = "_000000_job"


def ledger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger log: one scope per user, one version per day, tombstones from error events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("scope"),
        F.concat(F.date_format("ts", "yyMMdd"), F.lit(JOB)).alias("version"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("apply_time"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").cast("int").alias("is_deleted"),
        F.lit(None).cast("string").alias("batch_id"),
    )


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with the apply time cut to the day, so that many rows share a batch."""
    return ledger_log(spark, sf_dir).withColumn("apply_time", F.expr("apply_time - pmod(apply_time, 86400)"))


def single_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of one scope: one version per event, to the second."""
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("scope"),
        F.concat(F.date_format("ts", "yyMMdd_HHmmss"), F.lit("_e"), F.col("event_id")).alias("version"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("apply_time"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").cast("int").alias("is_deleted"),
        F.lit(None).cast("string").alias("batch_id"),
    )


LEDGER_SQL = f"""
ledger AS (
  SELECT CAST(user_id AS VARCHAR) AS scope, strftime(ts, '%y%m%d') || '{JOB}' AS version,
         epoch_us(ts) // 1000000 AS apply_time, event_id AS seq,
         CAST(event_type = 'error' AS INTEGER) AS is_deleted
  FROM events),
state AS (
  SELECT * FROM ledger
  QUALIFY row_number() OVER (PARTITION BY scope, version ORDER BY apply_time DESC, seq DESC) = 1),
applied AS (SELECT * FROM state WHERE is_deleted = 0)"""

BATCH_LEDGER_SQL = LEDGER_SQL.replace(
    "epoch_us(ts) // 1000000 AS apply_time", "epoch_us(ts) // 86400000000 * 86400 AS apply_time"
)

SINGLE_LEDGER_SQL = """
ledger AS (
  SELECT 'events' AS scope, strftime(ts, '%y%m%d_%H%M%S') || '_e' || event_id AS version,
         epoch_us(ts) // 1000000 AS apply_time, event_id AS seq,
         CAST(event_type = 'error' AS INTEGER) AS is_deleted
  FROM events),
applied AS (SELECT * FROM ledger WHERE is_deleted = 0)"""


def stored_ledger(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> Ledger:
    """A written ledger with its base row at second 0 and the given rows, by default the whole log."""
    ledger = Ledger(spark, workspace(spark, "ledger"))
    ledger.initialize(apply_time=0)
    ledger.append(ledger_log(spark, sf_dir) if rows is None else rows)
    return ledger


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of ``orders`` in three versions: updates, deletes and inserts, with repeated keys.

    Version 1 raises every tenth price, version 2 changes the status of every twentieth order
    and deletes the keys ending in 1, version 3 inserts copies of the keys ending in 2 under new
    keys and brings back the deleted keys ending in 31.
    """
    orders = table(spark, sf_dir, "orders")
    image = F.struct(*orders.columns)
    key = F.col("o_orderkey")

    def changed(**columns):
        return F.struct(*[columns.get(c, F.col(c)).alias(c) for c in orders.columns])

    none = F.lit(None).cast(orders.schema)
    raised = changed(o_totalprice=F.col("o_totalprice") * 2)
    closed = changed(o_totalprice=F.col("o_totalprice") * 2, o_orderstatus=F.lit("X"))
    copied = changed(o_orderkey=F.col("o_orderkey") + 1000000000)

    def step(version, seq, op, before, after, wanted, target=key):
        return F.when(wanted, F.struct(
            target.alias("o_orderkey"), F.lit(version).alias("version"), F.lit(seq).cast("bigint").alias("seq"),
            F.lit(op).alias("op"), before.alias("before"), after.alias("after")))

    steps = F.array(
        step("240101_000000_raise", 1, "update", image, raised, key % 10 == 0),
        step("240102_000000_close", 2, "update", raised, closed, key % 20 == 0),
        step("240102_000000_close", 3, "delete", image, none, key % 10 == 1),
        step("240103_000000_copy", 4, "insert", none, copied, key % 10 == 2, key + 1000000000),
        step("240103_000000_copy", 5, "insert", none, image, key % 100 == 31),
    )
    return orders.select(F.inline(F.filter(steps, lambda s: s.isNotNull())))


def orders_after_sql(version: int) -> str:
    """SELECT of ``orders`` after the first versions of :func:`order_changes`."""
    price = "CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 2 ELSE o_totalprice END" if version >= 1 else "o_totalprice"
    status = "CASE WHEN o_orderkey % 20 = 0 THEN 'X' ELSE o_orderstatus END" if version >= 2 else "o_orderstatus"
    kept = {0: "true", 1: "true", 2: "o_orderkey % 10 <> 1"}.get(
        version, "(o_orderkey % 10 <> 1 OR o_orderkey % 100 = 31)")
    sql = f"""
SELECT o_orderkey, o_custkey, {status} AS o_orderstatus, {price} AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE {kept}"""
    if version >= 3:
        sql += """
UNION ALL
SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 10 = 2"""
    return sql
