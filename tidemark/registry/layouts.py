"""Partition layouts, write order and pruned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import PartitionField
from ..operators import layout
from ..operators.layout import Layout, SortField, sort_by
from ..session import table, workspace
from . import register
from .columns import bucket_ctes

_DAY = PartitionField("days", "ts")
_USER = PartitionField("bucket", "user_id", 4)
_DAY_SQL = "CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER)"


@register(f"""WITH {bucket_ctes("events", "event_id", "user_id")}
SELECT {_DAY_SQL} AS ts_days, CAST((h & 2147483647) % 4 AS INTEGER) AS user_id_bucket_4,
       count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
FROM events JOIN f4 ON id = event_id GROUP BY ALL""")
def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = table(spark, sf_dir, "events"), workspace(spark, "partitioned")
    layout.write_table(events, path, [_DAY, _USER])
    return layout.read_table(spark, path, events.schema, [_DAY, _USER]).groupBy("ts_days", "user_id_bucket_4").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum")
    )


_HALF = "TIMESTAMP '2024-01-16 00:00:00'"


@register(f"""WITH {bucket_ctes("events", "event_id", "user_id")}
SELECT CAST(ts >= {_HALF} AS INTEGER) AS spec_id, {_DAY_SQL} AS ts_days,
       CASE WHEN ts >= {_HALF} THEN CAST((h & 2147483647) % 4 AS INTEGER) END AS user_id_bucket_4, count(*) AS n
FROM events JOIN f4 ON id = event_id GROUP BY ALL""")
def spec_add_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = table(spark, sf_dir, "events"), workspace(spark, "spec-add")
    first = Layout(((_DAY,),))
    first.write(events.filter(f"ts < {_HALF}"), path)
    second = first.add(_USER)
    second.write(events.filter(f"ts >= {_HALF}"), path)
    return second.read(spark, path, events.schema).groupBy("spec_id", "ts_days", "user_id_bucket_4").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(f"""SELECT CAST(ts >= {_HALF} AS INTEGER) AS spec_id, {_DAY_SQL} AS ts_days,
       CASE WHEN ts < {_HALF} THEN user_id - user_id % 500 END AS user_id_truncate_500, count(*) AS n
FROM events GROUP BY ALL""")
def spec_drop_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = table(spark, sf_dir, "events"), workspace(spark, "spec-drop")
    by_user = PartitionField("truncate", "user_id", 500)
    first = Layout(((_DAY, by_user),))
    first.write(events.filter(f"ts < {_HALF}"), path)
    second = first.drop(PartitionField("truncate", "user_id", 500))
    second.write(events.filter(f"ts >= {_HALF}"), path)
    return second.read(spark, path, events.schema).groupBy("spec_id", "ts_days", "user_id_truncate_500").agg(
        F.count(F.lit(1)).alias("n")
    )


_ORDER = [
    SortField(PartitionField("months", "l_shipdate"), descending=True),
    sort_by("l_quantity", nulls_first=False),
    sort_by("l_orderkey", descending=True),
]


def _ordered(spark: SparkSession, sf_dir: str, distribution: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0)))
    spec, path = [PartitionField("years", "l_shipdate")], workspace(spark, "ordered")
    layout.write_table(lines, path, spec, _ORDER, distribution)
    return layout.order_violations(spark, path, lines.schema, _ORDER, spec).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_wrong").alias("n_wrong")
    )


@register("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong FROM lineitem")
def write_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, "range")


@register("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong FROM lineitem")
def write_ordered_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, "hash")


@register("""SELECT event_id, ts, user_id, event_type, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-12 06:00:00'""")
def pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = table(spark, sf_dir, "events"), workspace(spark, "pruned")
    spec = [_DAY, _USER]
    layout.write_table(events, path, spec)
    low, high = F.lit("2024-01-10 12:00:00"), F.lit("2024-01-12 06:00:00")
    stored = layout.read_table(spark, path, events.schema, spec)
    return layout.between(stored, events.schema, spec, "ts", low, high).select(
        "event_id", "ts", "user_id", "event_type", "value"
    )


@register("SELECT event_id, ts, user_id, event_type, value FROM events WHERE user_id = 8")
def pruned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = table(spark, sf_dir, "events"), workspace(spark, "lookup")
    layout.write_table(events, path, [_USER])
    stored = layout.read_table(spark, path, events.schema, [_USER])
    return layout.equal_to(stored, events.schema, [_USER], "user_id", 8).select(
        "event_id", "ts", "user_id", "event_type", "value"
    )


@register(f"""SELECT event_id, user_id, CAST(ts >= {_HALF} AS INTEGER) AS spec_id FROM events e
WHERE EXISTS (SELECT 1 FROM events k WHERE k.event_type = 'error' AND CAST(k.ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-20')
  AND k.user_id = e.user_id AND k.ts = e.ts)""")
def pruned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened together with the errors of two days, from a table with two specs, by days and by bucket."""
    events, path = table(spark, sf_dir, "events"), workspace(spark, "pruned-join")
    first = Layout(((_DAY,),))
    first.write(events.filter(f"ts < {_HALF}"), path)
    second = first.add(_USER)
    second.write(events.filter(f"ts >= {_HALF}"), path)
    days = F.to_date("ts").isin(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))
    keys = events.filter((F.col("event_type") == "error") & days).select("ts", "user_id")
    return second.matching(spark, path, events.schema, keys).select("event_id", "user_id", "spec_id")
