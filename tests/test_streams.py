import pytest
from pyspark.sql import functions as F

from tidemark.operators.ledger_state import latest
from tidemark.registry.inputs import ledger_log
from tidemark.session import workspace
from tidemark.sources import scripts
from tidemark.streaming import ledger as ops

from .conftest import SF_DIR


def as_stream(df, path, n=4):
    df.repartition(n).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("every", [1, 2, 100])
def test_merged_state_equals_batch(spark, folder, every):
    log = ledger_log(spark, SF_DIR)
    stream = as_stream(log, folder + "/in")
    ops.merge_log(stream, folder + "/state", folder + "/progress", every).awaitTermination()
    assert same(latest(log), ops.read_merged(spark, folder + "/state"))


@pytest.mark.parametrize("every", [1, 2])
def test_replayed_epochs_change_nothing(spark, folder, every):
    log = ledger_log(spark, SF_DIR)
    stream = as_stream(log, folder + "/in")
    for progress in ("one", "two"):
        ops.merge_log(stream, folder + "/state", f"{folder}/{progress}", every).awaitTermination()
    assert same(latest(log), ops.read_merged(spark, folder + "/state"))


def test_empty_state(spark, folder):
    assert ops.read_merged(spark, folder + "/none").isEmpty()


def test_new_scripts_are_seen_once(spark, folder):
    def write(name):
        lines = spark.range(2).select(F.lit(name).alias("file"), F.lit("x").alias("line"), F.col("id").alias("at"))
        scripts.write_scripts(lines, folder + "/in", mode="append")

    seen = []
    for name in ("240101_000000_aa.up.sql", "240102_000000_bb.up.sql"):
        write(name)
        for _ in range(2):
            ops.new_scripts(spark, folder + "/in", folder + "/out", folder + "/progress").awaitTermination()
        rows = spark.read.schema("file string, n_chars int, epoch int").parquet(folder + "/out")
        seen.append(sorted((r.file[:6], r.n_chars, r.epoch) for r in rows.collect()))
    assert seen == [[("240101", 4, 0)], [("240101", 4, 0), ("240102", 4, 1)]]


@pytest.mark.parametrize("hot_keys", [False, True])
def test_one_key_in_most_deliveries(spark, folder, hot_keys):
    rows = spark.range(0, 3_000, 1, 3).select(
        F.when(F.col("id") % 3 < 2, -1).otherwise(F.col("id") % 500).alias("key"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") % 60).alias("t"))
    once = ops.drop_redelivered(as_stream(rows, folder + "/in"), ["key"], "t", "1 hour", hot_keys)
    out = folder + "/out"
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder + "/p").trigger(
        availableNow=True).start().awaitTermination()
    got = [r.key for r in spark.read.schema(once.schema).parquet(out).collect()]
    assert sorted(got) == sorted(r.key for r in rows.select("key").distinct().collect())


def test_redelivery_inside_the_delay(spark, folder):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:06:00")], "id int, t string")
    stream = as_stream(rows.withColumn("t", F.col("t").cast("timestamp")), folder + "/in", 1)
    once = ops.drop_redelivered(stream, ["id"], "t", "10 minutes")
    out = workspace(spark, "test-once")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder + "/p").trigger(
        availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.schema(once.schema).parquet(out).collect()) == [1, 2]
