"""Schema evolution on files with field ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.datatypes import type_change
from ..functions.transforms import PartitionField
from ..operators import schema as ops
from ..operators.layout import read_table, sort_by, write_table
from ..operators.schema import SchemaChange, change_schema_to, declare
from ..session import table, workspace
from . import register

_EVENTS = {
    "event_id": "long", "ts": "timestamp_ntz", "user_id": "long", "event_type": "string",
    "value": "double", "props": "string",
}

# The life of a table: each version holds one change.
_CHAIN = [
    ("240612_081500_region", SchemaChange("add", "region", "string", comment="where the user was")),
    ("240619_140000_score", SchemaChange("add", "score", "float")),
    ("240703_093000_finer_score", SchemaChange("widen", "score", "double")),
    ("240711_170000_anonymous", SchemaChange("drop", "user_id")),
    ("240802_120000_amount", SchemaChange("rename", "value", new_name="amount")),
]


def _written(spark: SparkSession, label: str, *generations: tuple[DataFrame, ops.TableSchema]) -> list[str]:
    root = workspace(spark, label)
    return [ops.write_generation(df, schema, f"{root}/gen={i}") for i, (df, schema) in enumerate(generations)]


@register("""SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS "user",
  CAST(NULL AS INTEGER) AS rank, value AS price, props AS item_props, CAST(event_id AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS note,
  CAST(ts AS DATE) AS day FROM events""")
def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("ts").alias("day"), F.struct("user_id", "event_type").alias("who"),
        F.array(F.struct("value", "props")).alias("items"), F.create_map("event_type", "event_id").alias("tags"), "event_id",
    )
    wanted = declare({
        "event_id": "string", "who": "struct<event_type:string,user_id:string,rank:int>",
        "items": "list<struct<props:string,value:decimal(12,2)>>", "tags": "map<string,string>",
        "note": "string", "day": "date",
    })
    return ops.conform(rows, wanted).select(
        "event_id", F.col("who.event_type").alias("kind"), F.col("who.user_id").alias("user"), "who.rank",
        F.col("items")[0]["value"].cast("double").alias("price"), F.col("items")[0]["props"].alias("item_props"),
        F.element_at("tags", F.col("who.event_type")).alias("tag"), "note", "day",
    )


@register("""SELECT event_id, ts, user_id, event_type, value, props,
  CASE WHEN event_id % 2 = 1 THEN 'r' || user_id END AS region FROM events""")
def evolve_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, old = table(spark, sf_dir, "events"), declare(_EVENTS)
    new = change_schema_to(old, _CHAIN[:1])
    paths = _written(
        spark, "add", (events.filter("event_id % 2 = 0"), old),
        (events.filter("event_id % 2 = 1").withColumn("region", F.concat(F.lit("r"), "user_id")), new),
    )
    return ops.read_generations(spark, new, paths)


@register("SELECT event_id, ts, user_id, event_type, value FROM events")
def evolve_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, old = table(spark, sf_dir, "events"), declare(_EVENTS)
    new = ops.change_schema(old, SchemaChange("drop", "props"))
    paths = _written(spark, "drop", (events.filter("event_id % 2 = 0"), old), (events.filter("event_id % 2 = 1"), new))
    return ops.read_generations(spark, new, paths)


@register("SELECT event_id, ts, user_id, event_type AS action, value, props FROM events")
def evolve_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, old = table(spark, sf_dir, "events"), declare(_EVENTS)
    new = ops.change_schema(old, SchemaChange("rename", "event_type", new_name="action"))
    paths = _written(
        spark, "rename", (events.filter("event_id % 2 = 0"), old),
        (events.filter("event_id % 2 = 1").withColumnRenamed("event_type", "action"), new),
    )
    return ops.read_generations(spark, new, paths)


@register("""SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_linenumber AS BIGINT) ELSE l_linenumber + 5000000000 END AS l_linenumber,
  CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS l_quantity,
  CAST(l_discount AS DOUBLE) + CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 100000000 END AS l_discount FROM lineitem""")
def evolve_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    old = declare({"l_orderkey": "long", "l_linenumber": "int", "l_quantity": "float", "l_discount": "decimal(9,2)"})
    new = change_schema_to(old, [
        ("240101_000000_line", SchemaChange("widen", "l_linenumber", "long")),
        ("240101_000001_quantity", SchemaChange("widen", "l_quantity", "double")),
        ("240101_000002_discount", SchemaChange("widen", "l_discount", "decimal(12,2)")),
    ])
    larger = lines.filter("l_orderkey % 2 = 1").withColumns({
        "l_linenumber": F.col("l_linenumber") + 5000000000, "l_discount": F.col("l_discount") + 100000000,
    })
    paths = _written(spark, "widen", (lines.filter("l_orderkey % 2 = 0"), old), (larger, new))
    return ops.read_generations(spark, new, paths).withColumn("l_discount", F.col("l_discount").cast("double"))


def _orders_generations(spark: SparkSession, sf_dir: str) -> tuple[ops.TableSchema, list[str]]:
    """``orders`` in two generations: renamed, widened, dropped, added again, and changed inside a struct."""
    orders = table(spark, sf_dir, "orders")
    old = declare({
        "o_orderkey": "long", "o_custkey": "int", "o_orderstatus": "string", "o_orderpriority": "string",
        "price": "struct<total:double,note:string>",
    })
    new = change_schema_to(old, [
        ("240101_000000_status", SchemaChange("rename", "o_orderstatus", new_name="status")),
        ("240101_000001_custkey", SchemaChange("widen", "o_custkey", "long")),
        ("240101_000002_drop", SchemaChange("drop", "o_orderpriority")),
        ("240101_000003_again", SchemaChange("add", "o_orderpriority", "string")),
        ("240101_000004_inner", SchemaChange("rename", "price.total", new_name="amount")),
        ("240101_000005_inner", SchemaChange("drop", "price.note")),
        ("240101_000006_inner", SchemaChange("add", "price.currency", "string")),
    ])
    before = orders.withColumn("price", F.struct(F.col("o_totalprice").alias("total"), F.lit("n").alias("note")))
    after = orders.withColumnRenamed("o_orderstatus", "status").withColumn(
        "price", F.struct(F.col("o_totalprice").alias("amount"), F.lit("EUR").alias("currency"))
    )
    half = F.col("o_orderkey") % 2 == 0
    return new, _written(spark, "orders", (before.filter(half), old), (after.filter(~half), new))


_MIXED_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice AS amount,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 2 = 1 THEN 'EUR' END AS currency FROM orders"""


def _flat(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", "o_custkey", "status", "price.amount", "o_orderpriority", "price.currency")


@register(_MIXED_SQL)
def mixed_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, paths = _orders_generations(spark, sf_dir)
    return _flat(ops.read_generations(spark, schema, paths))


@register(_MIXED_SQL)
def evolve_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, paths = _orders_generations(spark, sf_dir)
    rewritten = _written(spark, "backfill", (ops.read_generations(spark, schema, paths), schema))
    return _flat(ops.read_generations(spark, schema, rewritten))


@register("""SELECT event_id, ts, event_type, value, props, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS DOUBLE) AS score FROM events""")
def as_of_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = declare(_EVENTS, {"ts": "event time"})
    paths = _written(spark, "asof", (table(spark, sf_dir, "events"), created))
    return ops.read_generations(spark, change_schema_to(created, _CHAIN, "240711_170000"), paths)


_TYPES = ("int", "bigint", "float", "double", "decimal(9,2)", "decimal(12,2)", "decimal(12,4)", "string", "date", "timestamp_ntz")


@register(f"""WITH t AS (SELECT p_brand AS table_name, 'c' || p_partkey AS column_name,
    [{", ".join(f"'{t}'" for t in _TYPES)}][p_size % {len(_TYPES)} + 1] AS old_type,
    [{", ".join(f"'{t}'" for t in _TYPES)}][p_partkey % {len(_TYPES)} + 1] AS new_type FROM part)
SELECT *, CASE WHEN old_type = new_type THEN 'same' WHEN (old_type, new_type) IN (VALUES
  ('int', 'bigint'), ('float', 'double'), ('decimal(9,2)', 'decimal(12,2)')) THEN 'widen' ELSE 'refuse' END AS verdict FROM t""")
def evolve_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*[F.lit(t) for t in _TYPES])
    planned = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("table_name"), F.concat(F.lit("c"), "p_partkey").alias("column_name"),
        F.get(types, F.col("p_size") % len(_TYPES)).alias("old_type"),
        F.get(types, (F.col("p_partkey") % len(_TYPES)).cast("int")).alias("new_type"),
    )
    return planned.withColumn("verdict", type_change("old_type", "new_type"))


_NARROW = {
    "l_quantity": ("double", "int", "try_cast(try_cast(l_quantity AS INTEGER) AS DOUBLE) = l_quantity"),
    "l_discount": ("double", "int", "floor(l_discount) = l_discount"),
    "l_orderkey": ("bigint", "int", "abs(l_orderkey) < 2147483648"),
    "l_extendedprice": ("double", "float", "CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) = l_extendedprice"),
    "l_tax": ("double", "decimal(3,1)", "round(l_tax * 10, 6) = floor(round(l_tax * 10, 6))"),
    "l_shipdate": ("timestamp_ntz", "date", "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) = l_shipdate"),
    "l_returnflag": ("string", "int", "regexp_full_match(l_returnflag, '[0-9]+')"),
}


@register(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{old}' AS old_type, '{new}' AS new_type, count(*) AS n_rows, "
    f"count(*) FILTER (NOT ({kept})) AS n_lost FROM lineitem"
    for c, (old, new, kept) in _NARROW.items()))
def narrow_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.narrowing_audit(table(spark, sf_dir, "lineitem"), {c: new for c, (_, new, _) in _NARROW.items()})


@register("""WITH before AS (SELECT p_brand AS table_name, p_partkey AS field_id, p_name AS column_name, p_type AS column_type FROM part
  WHERE p_partkey % 11 <> 3),
after AS (SELECT p_brand AS table_name, p_partkey AS field_id,
    CASE WHEN p_partkey % 7 = 0 THEN p_name || ' new' ELSE p_name END AS column_name,
    CASE WHEN p_partkey % 5 = 0 THEN lower(p_type) ELSE p_type END AS column_type FROM part WHERE p_partkey % 13 <> 4)
SELECT coalesce(b.table_name, a.table_name) AS table_name, coalesce(b.field_id, a.field_id) AS field_id,
    b.column_name AS old_name, b.column_type AS old_type, a.column_name AS new_name, a.column_type AS new_type,
    CASE WHEN b.field_id IS NULL THEN 'added' WHEN a.field_id IS NULL THEN 'dropped'
      WHEN b.column_name <> a.column_name AND b.column_type <> a.column_type THEN 'renamed and retyped'
      WHEN b.column_name <> a.column_name THEN 'renamed' ELSE 'retyped' END AS change
FROM before b FULL JOIN after a ON a.table_name = b.table_name AND a.field_id = b.field_id
WHERE b.field_id IS NULL OR a.field_id IS NULL OR b.column_name <> a.column_name OR b.column_type <> a.column_type""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("table_name"), F.col("p_partkey").alias("field_id"),
        F.col("p_name").alias("column_name"), F.col("p_type").alias("column_type"),
    )
    field = F.col("field_id")
    renamed = F.when(field % 7 == 0, F.concat("column_name", F.lit(" new"))).otherwise(F.col("column_name"))
    retyped = F.when(field % 5 == 0, F.lower("column_type")).otherwise(F.col("column_type"))
    after = columns.filter(field % 13 != 4).withColumns({"column_name": renamed, "column_type": retyped})
    return ops.schema_diff(columns.filter(field % 11 != 3), after)


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice,
  CAST(NULL AS VARCHAR) AS note, CAST(year(o_orderdate) - 1970 AS INTEGER) AS o_orderdate_years FROM orders""")
def create_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = declare(
        {"o_orderkey": "string", "o_orderdate": "date", "o_totalprice": "double", "note": "string"},
        {"note": "free text"},
    )
    spec, path = [PartitionField("years", "o_orderdate")], workspace(spark, "load")
    write_table(ops.conform(table(spark, sf_dir, "orders"), schema), path, spec, [sort_by("o_totalprice", descending=True)])
    return read_table(spark, path, schema.columns, spec)
