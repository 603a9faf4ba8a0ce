"""Ledger semantics on streams that replay the given tables in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import apply_changes, change_schema
from ..session import table, workspace
from ..sources import scripts
from ..sources.batches import BatchStore
from ..streaming import ledger as ops
from ..streaming import state as states
from . import register
from .inputs import LEDGER_SQL, ledger_log, order_changes, orders_after_sql

_BATCHES = 4


def _as_stream(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as several files and read them back one micro-batch after the other."""
    spark, path = df.sparkSession, workspace(df.sparkSession, label)
    df.repartition(_BATCHES).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@register(f"WITH {LEDGER_SQL} SELECT scope, version, apply_time, seq, is_deleted FROM state")
def stream_ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "merged")
    stream = _as_stream(ledger_log(spark, sf_dir), "ledger-stream")
    ops.merge_log(stream, path, workspace(spark, "progress"), compact_every=2).awaitTermination()
    return ops.read_merged(spark, path).drop("batch_id")


@register(orders_after_sql(3))
def stream_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream runs twice from the start; the second run finds every epoch applied."""
    changes, orders = order_changes(spark, sf_dir), table(spark, sf_dir, "orders")
    store = BatchStore(spark, workspace(spark, "change-batches"))
    stream = _as_stream(changes, "change-stream")
    for _ in range(2):
        ops.apply_change_stream(stream, store, "changes", "orders", workspace(spark, "progress")).awaitTermination()
    stored = store.read("changes", change_schema(orders.schema, ["o_orderkey"]))
    return apply_changes(orders, stored, ["o_orderkey"])


@register("""SELECT strftime(ts, '%y%m%d') || '_000000_load-' || event_id // 2000 || '.up.sql' AS file,
  CAST(min(ts) >= TIMESTAMP '2024-01-16' AS INTEGER) AS epoch, CAST(sum(length(CAST(event_id AS VARCHAR)) + 1) AS INTEGER) AS n_chars
FROM events GROUP BY strftime(ts, '%y%m%d'), event_id // 2000""")
def stream_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of the first half of the month come first, the others before the second run."""
    lines = table(spark, sf_dir, "events").select(
        F.concat(F.date_format("ts", "yyMMdd"), F.lit("_000000_load-"), F.floor(F.col("event_id") / 2000),
                 F.lit(".up.sql")).alias("file"),
        F.col("event_id").cast("string").alias("line"), F.col("event_id").alias("at"),
    )
    path, out, progress = workspace(spark, "inbox"), workspace(spark, "seen"), workspace(spark, "progress")
    for wave in ("file < '240116'", "file >= '240116'"):
        scripts.write_scripts(lines.filter(wave), path, mode="append")
        ops.new_scripts(spark, path, out, progress).awaitTermination()
    return spark.read.schema("file string, n_chars int, epoch int").parquet(out)


@register("SELECT DISTINCT event_id, ts, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is delivered a second time."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    delivered = events.unionAll(events.filter("event_id % 3 = 0"))
    once = ops.drop_redelivered(_as_stream(delivered, "deliveries"), ["event_id"], "ts", "60 days")
    out = workspace(spark, "once")
    once.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", workspace(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _in_waves(rows: DataFrame, waves: list[str], run) -> None:
    """Write the rows of one wave after the other to the folder of a stream, which runs after each."""
    spark, path = rows.sparkSession, workspace(rows.sparkSession, "waves")
    for wave in waves:
        rows.filter(wave).write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


@register(f"WITH {LEDGER_SQL} SELECT scope, version, apply_time, seq, is_deleted FROM state")
def stream_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three waves in the order of time; versions that have had no row for five days leave the state."""
    log = ledger_log(spark, sf_dir).drop("batch_id").withColumn("at", F.timestamp_seconds("apply_time"))
    keys, order = ["scope", "version"], ["apply_time", "seq"]
    out, progress = workspace(spark, "closed"), workspace(spark, "progress")
    _in_waves(log, ["version < '240111'", "version >= '240111' AND version < '240121'", "version >= '240121'"],
              lambda stream: states.start(
                  states.latest_by_key(stream, keys, order, "at", "1 hour", 5 * 86400, salts=2), out, progress))
    return states.current(spark, out, progress, log.schema, keys, order).drop("at")


@register("""SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 = 0
  AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events WHERE event_id % 10 <> 0) - 10 * 86400000""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event is delivered after all others; what is more than ten days old then is late."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    out, progress = workspace(spark, "late"), workspace(spark, "progress")
    _in_waves(events, ["event_id % 10 <> 0", "event_id % 10 = 0"], lambda stream: states.start(
        states.latest_by_key(stream, ["user_id"], ["at", "event_id"], "at", "10 days", 86400), out, progress))
    return states.emitted(spark, out, events.schema, states.LATE).drop("at")
