import datetime
import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.datatypes import spark_type, type_change
from tidemark.operators import schema as ops
from tidemark.operators.schema import SchemaChange, change_schema, change_schema_to, declare


@pytest.mark.parametrize("text, expected", [
    ("INT", "int"), ("Integer", "int"), ("long", "bigint"), ("bigint", "bigint"), ("float", "float"),
    ("decimal", "decimal(38,0)"), ("decimal(9)", "decimal(9,0)"), ("DECIMAL( 9 , 2 )", "decimal(9,2)"),
    ("time", "bigint"), ("uuid", "string"), ("timestamp", "timestamp"), ("timestamp_ntz", "timestamp_ntz"),
    ("list<long>", "array<bigint>"), ("map<string, list<decimal>>", "map<string,array<decimal(38,0)>>"),
    ("struct<time: time, long: struct<uuid: uuid>>", "struct<time:bigint,long:struct<uuid:string>>"),
])
def test_types(spark, text, expected):
    assert spark_type(text).simpleString() == expected


@pytest.mark.parametrize("text", ["varchar(10)", "text", "int not null", "map<string>", "tinyint", "struct<a: interval>", "list<>"])
def test_unknown_types(spark, text):
    with pytest.raises(Exception):
        spark_type(text)


def test_ids_children_first_and_never_reused(spark):
    schema = declare({"a": "int", "s": "struct<x:int,l:list<struct<y:int>>>", "b": "string"})
    ids = {f.name: f.metadata[ops.FIELD_ID] for f in schema.columns.fields}
    assert ids == {"a": 1, "s": 5, "b": 6} and schema.last_id == 6
    dropped = change_schema(schema, SchemaChange("drop", "b"))
    again = change_schema(dropped, SchemaChange("add", "b", "string", comment="new"))
    assert again.columns["b"].metadata == {"comment": "new", ops.FIELD_ID: 7} and again.last_id == 7


@pytest.mark.parametrize("change", [
    SchemaChange("add", "a", "int"), SchemaChange("drop", "x"), SchemaChange("rename", "x", new_name="y"),
    SchemaChange("rename", "a", new_name="b"), SchemaChange("widen", "b", "int"), SchemaChange("widen", "a", "string"),
    SchemaChange("widen", "d", "decimal(9,3)"), SchemaChange("widen", "d", "decimal(8,2)"), SchemaChange("widen", "t", "timestamp_ntz"),
    SchemaChange("add", "a.x", "int"), SchemaChange("add", "A.x", "int"), SchemaChange("comment", "a"), SchemaChange("drop", "A"),
])
def test_refused_changes(spark, change):
    schema = declare({"a": "int", "b": "long", "d": "decimal(9,2)", "t": "date"})
    with pytest.raises(ValueError):
        change_schema(schema, change)


def test_as_of_uses_version_order(spark):
    schema = declare({"a": "int"})
    chain = [("240103_000000_c", SchemaChange("rename", "b", new_name="c")), ("240102_000000_b", SchemaChange("add", "b", "int"))]
    assert change_schema_to(schema, chain, "240102_000000").names == ["a", "b"]
    assert change_schema_to(schema, chain).names == ["a", "c"]


def test_type_change_agrees_with_the_rule_for_types(spark):
    written = ["int", "bigint", "float", "double", "decimal(9,2)", "decimal(12,2)", "decimal(12,3)", "string", "binary", "date", "timestamp_ntz"]
    pairs = [(a, b) for a in written for b in written]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", type_change("a", "b").alias("v")).collect()
    for a, b, verdict in got:
        assert (verdict != "refuse") == ops.is_widening(spark_type(a), spark_type(b)), (a, b)


def _ids_in_file(path):
    [file] = glob.glob(f"{path}/*.parquet")
    found = {}
    for field in pq.ParquetFile(file).schema_arrow:
        found[field.name] = int(field.metadata[b"PARQUET:field_id"])
        if hasattr(field.type, "fields"):
            for inner in field.type.fields:
                found[f"{field.name}.{inner.name}"] = int(inner.metadata[b"PARQUET:field_id"])
    return found


def test_files_carry_ids_at_every_level(spark, folder):
    schema = declare({"k": "long", "s": "struct<x:int,y:string>", "n": "string"})
    rows = spark.range(3).select(F.col("id").alias("k"), F.struct(F.lit("q").alias("y"), F.lit(1).alias("x")).alias("s"))
    ops.write_generation(rows.coalesce(1), schema, f"{folder}/g")
    assert _ids_in_file(f"{folder}/g") == {"k": 1, "s": 4, "s.x": 2, "s.y": 3, "n": 5}


def test_old_values_stay_hidden_under_a_reused_name(spark, folder):
    first = declare({"k": "int", "v": "string"})
    ops.write_generation(spark.sql("select 1 k, 'old' v"), first, f"{folder}/g0")
    second = change_schema_to(first, [
        ("1", SchemaChange("drop", "v")), ("2", SchemaChange("add", "v", "string")),
        ("3", SchemaChange("rename", "k", new_name="key")), ("4", SchemaChange("widen", "key", "long")),
    ])
    ops.write_generation(spark.sql("select 5000000000 key, 'new' v"), second, f"{folder}/g1")
    both = ops.read_generations(spark, second, [f"{folder}/g0", f"{folder}/g1"])
    assert sorted(map(tuple, both.collect())) == [(1, None), (5000000000, "new")]
    assert [r.key for r in both.filter("key = 1").collect()] == [1], "filters find renamed and widened columns"


def test_only_wanted_columns_are_read(spark, folder):
    schema = declare({"k": "long", "v": "string"})
    ops.write_generation(spark.range(3).withColumnRenamed("id", "k"), schema, f"{folder}/g")
    plan = ops.read_generations(spark, schema, [f"{folder}/g"]).filter("k > 1").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint>" in plan and "GreaterThan(k,1)" in plan


def test_conform_keeps_missing_structs_null(spark):
    rows = spark.sql("select cast(null as struct<a:int>) s, array(cast(null as struct<a:int>)) l, map('1', 2) m")
    wanted = declare({"m": "map<int,string>", "l": "list<struct<b:int,a:string>>", "s": "struct<b:int,a:long>"})
    assert tuple(ops.conform(rows, wanted).first()) == ({1: "2"}, [None], None)


def test_narrowing_audit(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, "7", None), (2**40, 1.5, "x", datetime.datetime(2024, 1, 1)), (None, 1e300, "07", datetime.datetime(2024, 1, 1, 1))],
        "a bigint, b double, c string, d timestamp_ntz")
    got = {r.column_name: (r.n_rows, r.n_lost) for r in ops.narrowing_audit(
        rows, {"a": "int", "b": "int", "c": "int", "d": "date"}).collect()}
    assert got == {"a": (3, 1), "b": (3, 2), "c": (3, 2), "d": (3, 1)}


def test_schema_diff(spark):
    before = declare({"a": "int", "b": "int", "c": "int"})
    after = change_schema_to(before, [
        ("1", SchemaChange("rename", "a", new_name="x")), ("2", SchemaChange("widen", "x", "long")),
        ("3", SchemaChange("drop", "b")), ("4", SchemaChange("add", "b", "int")),
    ])
    kind = "table_name string, field_id int, column_name string, column_type string"
    frames = [spark.createDataFrame(ops.column_inventory("t", s), kind) for s in (before, after)]
    got = {(r.field_id, r.change) for r in ops.schema_diff(*frames).collect()}
    assert got == {(1, "renamed and retyped"), (2, "dropped"), (4, "added")}


def test_comments_must_name_columns(spark):
    with pytest.raises(ValueError):
        declare({"a": "int"}, {"b": "?"})
    json.dumps(declare({"a": "int"}, {"a": "text"}).columns.jsonValue())
    assert isinstance(declare(T.StructType([T.StructField("a", T.IntegerType(), False)])).columns["a"].nullable, bool)
