"""Tables whose schema, specs and order are read back from their own log."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import PartitionField
from ..operators import metadata
from ..operators.layout import SortField
from ..operators.schema import SchemaChange, TableSchema, change_schema_to, declare, write_generation
from ..session import table, workspace
from ..sources import footers
from ..sources.footers import file_inventory
from ..sources.tables import Refused, StoredTable, TableStore, change, changes_frame
from . import register
from .inputs import stored_ledger


def _cells(name: str, stored: StoredTable, key: str) -> DataFrame:
    """(table_name, row_key, field_id, column_name, value): every value of a table as text."""
    fields = stored.schema.columns.fields
    cells = F.array(*[F.struct(F.lit(f.metadata["parquet.field.id"]).alias("field_id"), F.lit(f.name).alias("column_name"),
                               F.col(f.name).cast("string").alias("value")) for f in fields])
    return stored.read().select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), F.inline(cells))


def _cells_sql(name: str, key: str, source: str, **columns: tuple[int, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {key} AS row_key, {i} AS field_id, '{c}' AS column_name, CAST({v} AS VARCHAR) AS value FROM {source}"
        for c, (i, v) in columns.items())


# Each third of a table is written under another version of it.
@register(" UNION ALL ".join((
    _cells_sql("visits", "event_id", "events", event_id=(1, "event_id"), at=(2, "CAST(ts AS DATE)"), visitor=(3, "user_id"),
               action=(4, "event_type"), channel=(6, "CASE WHEN event_id % 3 > 0 THEN 'c' || user_id % 5 END"),
               note=(7, "CASE WHEN event_id % 3 = 2 THEN props END")),
    _cells_sql("sales", "o_orderkey", "orders", o_orderkey=(1, "o_orderkey"),
               buyer=(2, "CASE WHEN o_orderkey % 3 = 2 THEN o_custkey + 5000000000 ELSE o_custkey END"), o_orderstatus=(3, "o_orderstatus"),
               cents=(5, "CASE WHEN o_orderkey % 3 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END")))))
def evolve_by_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables through all kinds of changes, written in between, and read by what their log says."""
    path = workspace(spark, "tables")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("date").alias("at"), F.col("user_id").alias("visitor"), F.col("event_type").alias("kind"), "props")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("custkey"), "o_orderstatus", "o_orderpriority")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")

    def third(n: int, key: str):
        return F.col(key) % 3 == n

    store = TableStore(spark, path)
    store.create("visits", "240301_090000_visits", {"event_id": "long", "at": "date", "visitor": "long", "kind": "string", "props": "string"},
                 comments={"at": "day of the visit"}, partitions=[PartitionField("months", "at")], properties={"owner": "web"})
    store.create("sales", "240301_090500_sales", {"o_orderkey": "long", "custkey": "int", "o_orderstatus": "string", "o_orderpriority": "string"},
                 order=[SortField(PartitionField("identity", "o_orderkey"))])
    store.open("visits").append(events.filter(third(0, "event_id")))
    store.open("sales").append(orders.filter(third(0, "o_orderkey")))
    second = "240302_120000_columns"
    store.record(changes_frame(spark, [
        change("visits", second, "add", "channel", "string"), change("visits", second, "drop", "props"),
        change("visits", second, "add_partition", "visitor", transform="truncate", param=500),
        change("sales", second, "add", "cents", "long"), change("sales", second, "drop", "o_orderpriority"),
        change("sales", second, "rename", "custkey", "buyer")]))
    channel = F.concat(F.lit("c"), F.col("visitor") % 5)
    store.open("visits").append(events.filter(third(1, "event_id")).withColumn("channel", channel))
    priced = orders.join(table(spark, sf_dir, "orders").select("o_orderkey", cents.alias("cents")), "o_orderkey").withColumnRenamed("custkey", "buyer")
    store.open("sales").append(priced.filter(third(1, "o_orderkey")))
    third_version = "240310_060000_more"
    store.record(changes_frame(spark, [
        change("visits", third_version, "rename", "kind", "action"), change("visits", third_version, "add", "note", "string"),
        change("visits", third_version, "drop_partition", "at_months"), change("visits", third_version, "order_by", "at", descending=True),
        change("sales", third_version, "widen", "buyer", "long"), change("sales", third_version, "add_partition", "o_orderstatus"),
        change("sales", third_version, "unordered")]))
    latest = events.withColumnsRenamed({"kind": "action", "props": "note"}).withColumn("channel", channel)
    store.open("visits").append(latest.filter(third(2, "event_id")))
    store.open("sales").append(priced.filter(third(2, "o_orderkey")).withColumn("buyer", F.col("buyer") + 5_000_000_000))

    reopened = TableStore(spark, path)
    return _cells("visits", reopened.open("visits"), "event_id").unionByName(_cells("sales", reopened.open("sales"), "o_orderkey"))


_USER_CHANGES_SQL = """
changes AS (
  SELECT user_id, event_id, event_type, strftime(ts, '%y%m%d_%H%M%S') AS stamp,
    lag(event_id) OVER w AS before_id, lag(event_type) OVER w AS before_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
adds AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS field_id FROM changes WHERE event_type <> 'error'),
asks AS (SELECT DISTINCT user_id, stamp FROM changes WHERE event_type IN ('purchase', 'error')),
reach AS (SELECT a.user_id, a.stamp, max(c.event_id) AS upto FROM asks a JOIN changes c ON a.user_id = c.user_id AND c.stamp <= a.stamp GROUP BY ALL),
totals AS (
  SELECT r.user_id, r.stamp, r.upto, count(*) FILTER (c.event_type <> 'error') AS last_id, 1 + count(*) FILTER (c.event_type = 'click' AND c.before_id IS NOT NULL) AS n_specs,
    count(*) FILTER (c.event_type = 'error' AND (c.before_id IS NULL OR c.before_type IN ('error', 'click'))) AS n_refused
  FROM reach r JOIN changes c ON c.user_id = r.user_id AND c.event_id <= r.upto GROUP BY ALL)
"""


# Every user of the events is a table: each event adds a column, a purchase widens it, a click partitions by it, an error drops the one before.
# A click that is a user's first event belongs to the version that makes the table, and so to its first spec.
@register(f"""WITH {_USER_CHANGES_SQL}
SELECT 'u' || t.user_id AS table_name, t.stamp AS as_of, t.last_id::INTEGER AS last_id, t.n_specs::INTEGER AS n_specs, t.n_refused::INTEGER AS n_refused,
  a.field_id::INTEGER AS field_id, 'c' || a.event_id AS column_name,
  CASE WHEN a.event_id % 2 = 0 THEN CASE a.event_type WHEN 'purchase' THEN 'bigint' ELSE 'int' END
    WHEN a.event_id % 2 = 1 THEN CASE a.event_type WHEN 'purchase' THEN 'double' ELSE 'float' END END AS column_type
FROM totals t LEFT JOIN adds a ON a.user_id = t.user_id AND a.event_id <= t.upto AND NOT EXISTS (
  SELECT 1 FROM changes d WHERE d.user_id = t.user_id AND d.event_id <= t.upto AND d.event_type = 'error'
    AND d.before_id = a.event_id AND a.event_type <> 'click')""")
def metadata_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of many tables as of many versions, in one fold of their log."""
    log, asked = user_changes(spark, sf_dir)
    n_refused = F.aggregate(F.map_values("n_refused"), F.lit(0).cast("long"), lambda n, m: n + m).cast("int")
    return metadata.counted_states(log, asked).select(
        "table_name", "as_of", "last_id", F.size("specs").alias("n_specs"), n_refused.alias("n_refused"), F.explode_outer("columns").alias("c")
    ).select("table_name", "as_of", "last_id", "n_specs", "n_refused", "c.field_id", F.col("c.name").alias("column_name"), F.col("c.type").alias("column_type"))


def user_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A log with one table per user, and the versions asked for."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("table_name"), F.date_format("ts", "yyMMdd_HHmmss").alias("stamp"), "event_id", "event_type")
    name, even = F.concat(F.lit("c"), "event_id"), F.col("event_id") % 2 == 0
    before = F.expr("concat('c', coalesce(lag(event_id) OVER (PARTITION BY table_name ORDER BY event_id), -1))")
    first = F.expr("row_number() OVER (PARTITION BY table_name ORDER BY event_id) = 1")
    kind, nothing = F.col("event_type"), F.lit(None).cast("string")

    def step(wanted, at, what, column, value=nothing):
        return F.when(wanted, F.struct((F.col("event_id") * 4 + at).alias("seq"), F.lit(what).alias("kind"), column.alias("name"), value.alias("value")))

    steps = F.array(
        step(F.col("first"), 0, "create", nothing),
        step(kind != "error", 1, "add", name, F.when(even, "INT").otherwise("float")),
        step(kind == "purchase", 2, "widen", name, F.when(even, "long").otherwise("double")),
        step(kind == "click", 2, "add_partition", name),
        step(kind == "error", 2, "drop", F.col("before")))
    log = events.withColumns({"first": first, "before": before}).select(
        "table_name", F.concat("stamp", F.lit("_e"), "event_id").alias("version"), F.inline(F.filter(steps, lambda s: s.isNotNull())))
    asked = events.filter(kind.isin("purchase", "error")).select("table_name", F.col("stamp").alias("as_of"))
    return log, asked


@register("""SELECT o_orderpriority AS table_name, count(*) AS n_asked, CAST(1 AS BIGINT) AS n_created, CAST(count(*) - 1 AS BIGINT) AS n_refused,
  CAST(3 AS INTEGER) AS last_id FROM orders GROUP BY o_orderpriority""")
def create_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks for a table named after its priority: the first request makes it, later ones are refused and change nothing."""
    orders = table(spark, sf_dir, "orders")
    wanted = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(value).alias("value"))
                       for i, (kind, name, value) in enumerate([("create", None, None), ("add", "a", "int"), ("add", "s", "struct<x:int>")])])
    log = orders.select(F.col("o_orderpriority").alias("table_name"), F.concat(F.date_format("o_orderdate", "yyMMdd_HHmmss"), F.lit("_new")).alias("version"),
                        "o_orderkey", F.inline(wanted)).withColumn("seq", F.col("o_orderkey") * 4 + F.col("at"))
    asked = orders.groupBy(F.col("o_orderpriority").alias("table_name")).agg(F.count("*").alias("n_asked"))
    # A create is refused for one reason only: the table exists.
    n_again = F.coalesce(F.try_element_at("n_refused", F.lit("create")), F.lit(0))
    states = metadata.counted_states(log).select("table_name", "last_id", n_again.alias("n_again"))
    return asked.join(states, "table_name").select(
        "table_name", "n_asked", (F.col("n_asked") - F.col("n_again")).alias("n_created"), F.col("n_again").cast("long").alias("n_refused"), "last_id")


@register("""SELECT count(*) AS n_rows, sum(l_linenumber + 5000000000)::BIGINT AS total, true AS refused, 'bigint' AS column_type, CAST(1 AS BIGINT) AS n_applied
FROM lineitem""")
def refused_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version widened a column and wider values were written. Taking it back would narrow: refused, and the version stays applied."""
    store, ledger = TableStore(spark, workspace(spark, "tables")), stored_ledger(spark, sf_dir)
    widened = "240401_000000_widen"
    store.create("lines", "240331_000000_lines", {"l_orderkey": "long", "l_linenumber": "int"})
    store.record(changes_frame(spark, [change("lines", widened, "widen", "l_linenumber", "long")]))
    ledger.record(spark.range(1).select(F.lit("lines").alias("scope"), F.lit(widened).alias("version")), 1_700_000_000)
    lines = table(spark, sf_dir, "lineitem")
    store.open("lines").append(lines.select("l_orderkey", (F.col("l_linenumber") + 5_000_000_000).alias("l_linenumber")))
    refused = False
    try:
        store.step_down(widened, changes_frame(spark, [change("lines", widened, "widen", "l_linenumber", "int")]),
                        lambda: ledger.remove(spark.range(1).select(F.lit("lines").alias("scope"), F.lit(widened).alias("version"))))
    except Refused:
        refused = True
    stored = store.open("lines")
    applied = ledger.applied().filter((F.col("scope") == "lines") & (F.col("version") == widened)).count()
    return stored.read().agg(F.count("*").alias("n_rows"), F.sum("l_linenumber").alias("total")).select(
        "n_rows", "total", F.lit(refused).alias("refused"), F.lit(stored.schema.columns["l_linenumber"].dataType.simpleString()).alias("column_type"),
        F.lit(applied).cast("long").alias("n_applied"))


def _generations(spark: SparkSession, sf_dir: str) -> tuple[list[TableSchema], str]:
    """``orders`` written in two generations of a schema, without a store."""
    orders, root = table(spark, sf_dir, "orders"), workspace(spark, "generations")
    old = declare({"o_orderkey": "long", "o_custkey": "int", "o_orderdate": "timestamp_ntz", "o_orderstatus": "string"})
    new = change_schema_to(old, [
        ("240501_000000_a", SchemaChange("rename", "o_orderstatus", new_name="status")), ("240501_000000_b", SchemaChange("widen", "o_custkey", "long")),
        ("240501_000000_c", SchemaChange("drop", "o_orderdate")), ("240501_000000_d", SchemaChange("add", "o_orderpriority", "string"))])
    write_generation(orders.filter("o_orderkey % 3 = 0"), old, f"{root}/gen=0")
    write_generation(orders.filter("o_orderkey % 3 > 0").withColumnRenamed("o_orderstatus", "status"), new, f"{root}/gen=1")
    return [old, new], root


@register("""WITH g AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'gen=0' ELSE 'gen=1' END AS generation, count(*) AS n_rows FROM orders GROUP BY ALL),
held(generation, field_id, column_name, column_type) AS (VALUES
  ('gen=0', 1, 'o_orderkey', 'bigint'), ('gen=0', 2, 'o_custkey', 'int'), ('gen=0', 3, 'o_orderdate', 'timestamp_ntz'), ('gen=0', 4, 'o_orderstatus', 'string'),
  ('gen=1', 1, 'o_orderkey', 'bigint'), ('gen=1', 2, 'o_custkey', 'bigint'), ('gen=1', 4, 'status', 'string'), ('gen=1', 5, 'o_orderpriority', 'string'))
SELECT generation, field_id, column_name, column_type, n_rows FROM held JOIN g USING (generation)""")
def footer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of two generations hold, from their footers alone."""
    _, root = _generations(spark, sf_dir)
    held = file_inventory(spark, root).filter("n_rows > 0")
    return held.groupBy(F.regexp_extract("file", "gen=[0-9]+", 0).alias("generation"), "field_id", "column_name", "column_type").agg(F.sum("n_rows").alias("n_rows"))


@register("""SELECT field_id, change, file_name, file_type, column_name, column_type, n_rows FROM (VALUES
  (4, 'renamed', 'o_orderstatus', 'string', 'status', 'string'), (2, 'retyped', 'o_custkey', 'int', 'o_custkey', 'bigint'),
  (3, 'dropped', 'o_orderdate', 'timestamp_ntz', NULL, NULL), (5, 'added', NULL, NULL, 'o_orderpriority', 'string')
) AS d(field_id, change, file_name, file_type, column_name, column_type), (SELECT count(*) AS n_rows FROM orders WHERE o_orderkey % 3 = 0)""")
def drift_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in files that differ from the newest schema, by difference."""
    (_, new), root = _generations(spark, sf_dir)
    drift = footers.drift_of_files(file_inventory(spark, root).filter("n_rows > 0"), new)
    return drift.groupBy("field_id", "change", "file_name", "file_type", "column_name", "column_type").agg(F.sum("n_rows").alias("n_rows"))


@register("""SELECT event_id, user_id, event_type AS action, CASE WHEN event_id % 2 = 1 THEN props END AS note, true AS some_rewritten, true AS none_left,
  true AS new_files_kept FROM events""")
def backfill_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files older than a change are rewritten under the new columns and spec, in two runs; the rest stay, and no row changes."""
    store, version = TableStore(spark, workspace(spark, "tables")), "240602_000000_change"
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("int").alias("user_id"), "event_type", "props")
    store.create("events", "240601_000000_events", {"event_id": "long", "user_id": "int", "event_type": "string"})
    store.open("events").append(events.filter("event_id % 2 = 0"))
    store.record(changes_frame(spark, [
        change("events", version, "widen", "user_id", "long"), change("events", version, "rename", "event_type", "action"),
        change("events", version, "add", "note", "string"), change("events", version, "add_partition", "action")]))
    store.open("events").append(events.filter("event_id % 2 = 1").withColumnsRenamed({"event_type": "action", "props": "note"}))
    first, _ = store.backfill("events", version, most_bytes=1)
    more, _ = store.backfill("events", version)
    again, left = store.backfill("events", version)
    stored = store.open("events")
    retired = [r.file for r in stored.retired.collect()]
    return stored.read().select("*", F.lit(first + more > 0).alias("some_rewritten"), F.lit(again + left == 0).alias("none_left"),
                                F.lit(all(f.startswith("spec=0/") for f in retired)).alias("new_files_kept"))
