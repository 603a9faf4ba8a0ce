import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.transforms import PartitionField
from tidemark.operators import layout
from tidemark.operators.layout import Layout, SortField, sort_by
from tidemark.operators.schema import SchemaChange, change_schema, conform, declare
from tidemark.session import table

from .conftest import SF_DIR
from .plans import physical

DAY, USER = PartitionField("days", "ts"), PartitionField("bucket", "user_id", 8)


def files_read(df) -> int:
    """Files the scan really opened."""
    return df.select(F.col("_metadata.file_path").alias("f")).distinct().count()


def partition_filters(df) -> str:
    return physical(df).split("PartitionFilters: [")[1].split("], PushedFilters")[0]


def test_pruned_reads_open_few_files(spark, folder):
    events = table(spark, SF_DIR, "events")
    layout.write_table(events, folder + "/t", [DAY])
    stored = layout.read_table(spark, folder + "/t", events.schema, [DAY])
    low, high = F.lit("2024-01-05 10:00:00"), F.lit("2024-01-06 09:00:00")
    pruned = layout.between(stored, events.schema, [DAY], "ts", low, high)
    assert "ts_days" in partition_filters(pruned)
    assert pruned.count() == events.filter(F.col("ts").between(low, high)).count() > 0
    assert files_read(layout.between(stored, events.schema, [DAY], "ts", low, high)) == 2


@pytest.mark.parametrize("source, value", [("user_id", 8), ("event_type", "click")])
def test_bucket_lookup_prunes(spark, folder, source, value):
    events = table(spark, SF_DIR, "events")
    spec = [PartitionField("bucket", source, 8)]
    layout.write_table(events, folder + "/t", spec)
    stored = layout.read_table(spark, folder + "/t", events.schema, spec)
    found = layout.equal_to(stored, events.schema, spec, source, value)
    assert f"{source}_bucket_8" in partition_filters(found)
    assert found.count() == events.filter(F.col(source) == value).count()
    assert files_read(found) <= 1


def test_layout_changes(spark, folder):
    first = Layout(((DAY,),))
    with pytest.raises(ValueError):
        first.add(DAY)
    with pytest.raises(ValueError):
        first.drop(USER)
    with pytest.raises(ValueError):
        first.drop("ts_hours")
    second = first.add(USER)
    assert second.drop("ts_days").current == (USER,) and second.drop(PartitionField("days", "ts")).current == (USER,)
    events = table(spark, SF_DIR, "events")
    first.write(events.filter("event_id < 500"), folder + "/t")
    second.write(events.filter("event_id >= 500"), folder + "/t")
    third = second.drop("ts_days")
    assert third.read(spark, folder + "/none", events.schema).isEmpty()
    both = third.read(spark, folder + "/t", events.schema)
    assert both.count() == 1000
    assert both.filter("spec_id = 0 and user_id_bucket_8 is not null").count() == 0
    assert both.filter("spec_id = 1 and user_id_bucket_8 is null").count() == 0


def test_unknown_source_column(spark, folder):
    with pytest.raises(ValueError, match="not found"):
        layout.write_table(table(spark, SF_DIR, "events"), folder + "/t", [PartitionField("days", "when")])
    with pytest.raises(ValueError, match="distribution"):
        layout.write_table(table(spark, SF_DIR, "events"), folder + "/t", distribution="random")


def test_violations_are_found(spark, folder):
    rows = spark.createDataFrame([(1, None), (2, 5), (2, None), (1, 3)], "a int, b int").coalesce(1)
    rows.write.parquet(folder + "/t")

    def wrong(*order):
        found = layout.order_violations(spark, folder + "/t", rows.schema, order)
        return [(r.n_rows, r.n_wrong) for r in found.collect()]

    assert wrong(sort_by("a")) == [(4, 1)]
    assert wrong(sort_by("a"), sort_by("b", nulls_first=False)) == [(4, 1)]
    assert wrong(sort_by("a"), sort_by("b")) == [(4, 2)]
    assert wrong(sort_by("b", descending=True)) == [(4, 2)]


@pytest.mark.parametrize("distribution", ["range", "hash"])
def test_write_order_with_nulls(spark, folder, distribution):
    rows = table(spark, SF_DIR, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    order = [SortField(PartitionField("truncate", "l_orderkey", 100)), sort_by("l_tax", descending=True, nulls_first=True)]
    layout.write_table(rows, folder + "/t", [PartitionField("identity", "l_returnflag")], order, distribution)
    found = layout.order_violations(spark, folder + "/t", rows.schema, order, [PartitionField("identity", "l_returnflag")])
    assert tuple(found.agg(F.sum("n_rows"), F.sum("n_wrong")).first()) == (rows.count(), 0)


def test_a_hot_partition_is_cut_into_several_files(spark, folder):
    """One partition with most rows does not become one task."""
    rows = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 5).otherwise(F.lit(7)).alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        layout.write_table(rows, folder + "/t", [PartitionField("identity", "p")])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = layout.read_table(spark, folder + "/t", rows.schema, [PartitionField("identity", "p")])
    hot = stored.filter("p_identity = 7")
    assert hot.count() == 360_000 and files_read(hot) >= 4


@pytest.mark.parametrize("split_copies", [False, True])
def test_equal_rows_in_an_ordered_write(spark, folder, split_copies):
    """Two thirds of the rows are equal; only with ``split_copies`` do they leave one file."""
    rows = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 < 2, -5).otherwise(F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layout.write_table(rows, folder + "/t", (), [sort_by("v")], split_copies=split_copies)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = layout.read_table(spark, folder + "/t", rows.schema)
    assert stored.columns == ["v"] and stored.count() == 30_000 and stored.filter("v = -5").count() == 20_000
    assert layout.order_violations(spark, folder + "/t", rows.schema, [sort_by("v")]).filter("n_wrong > 0").isEmpty()
    assert (files_read(stored.filter("v = -5")) > 1) is split_copies


def test_written_tables_keep_field_ids_and_maps(spark, folder):
    schema = declare({"k": "long", "m": "map<string,int>", "s": "struct<x:int>"})
    rows = spark.range(4).select(F.col("id").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.struct(F.lit(1).alias("x")).alias("s"))
    spec = [PartitionField("truncate", "k", 2)]
    for name, order in (("a", ()), ("b", [sort_by("k")])):
        layout.write_table(conform(rows, schema), f"{folder}/{name}", spec, order)
        renamed = change_schema(change_schema(schema, SchemaChange("rename", "k", new_name="key")), SchemaChange("rename", "s.x", new_name="y"))
        stored = spark.read.schema(renamed.columns).option("recursiveFileLookup", True).parquet(f"{folder}/{name}")
        assert sorted((r.key, r.s.y, r.m["a"]) for r in stored.collect()) == [(i, 1, 1) for i in range(4)]


def test_shards_are_balanced(spark):
    rows = spark.range(10_000).select(F.col("id").cast("string").alias("version"))
    sizes = [r["count"] for r in layout.shard(rows, 8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)


def spoil(folder, keep):
    """Overwrite all data files below a folder, but those of the partitions to keep, with what no reader accepts."""
    left = 0
    for part in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        if any(k in part for k in keep):
            left += 1
        else:
            with open(part, "r+b") as f:
                f.write(b"\0" * os.path.getsize(part))
    return left


def test_a_joined_table_prunes_every_spec(spark, folder):
    schema = T.StructType.fromDDL("id bigint, day date, user bigint")
    rows = spark.range(4000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("day"),
                                    F.col("id").alias("user"))
    days = PartitionField("days", "day")
    first = Layout(((days,),))
    first.write(rows.filter("id < 2000"), folder)
    second = first.add(PartitionField("bucket", "user", 8))
    second.write(rows.filter("id >= 2000"), folder)
    keys = spark.createDataFrame([(45, "2024-01-06"), (45, "2024-01-06"), (2045, "2024-01-06"), (7, "2024-01-06"), (None, "2024-01-08")],
                                 "user int, day string")
    bucket = rows.filter("id = 2045 or id = 45 or id = 7").select(
        second.current[1].value(schema, F.col("user")).alias("b")).distinct().collect()
    day = 19723 + 5
    kept = spoil(folder, [f"spec=0/day_days={day}/", *[f"spec=1/day_days={day}/user_bucket_8={r.b}/" for r in bucket]])
    assert 2 <= kept <= 4
    found = second.matching(spark, folder, schema, keys)
    assert "dynamicpruning" in physical(found)
    assert sorted((r.id, r.spec_id) for r in found.collect()) == [(45, 0), (2045, 1)]
    # Without the keys of the other table the spoiled files are read.
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        second.read(spark, folder, schema).filter("user = 45").collect()


def test_matching_on_nothing_and_on_unpartitioned_columns(spark, folder):
    schema = T.StructType.fromDDL("id bigint, day date")
    layout_ = Layout(((PartitionField("days", "day"),),))
    keys = spark.createDataFrame([(3,), (3,), (None,)], "id bigint")
    assert layout_.matching(spark, folder, schema, keys).isEmpty()
    rows = spark.range(10).select("id", F.lit("2024-01-01").cast("date").alias("day"))
    layout_.write(rows.union(rows).union(rows.select(F.lit(None).cast("bigint"), "day")), folder)
    assert [tuple(r)[::2] for r in layout_.matching(spark, folder, schema, keys).collect()] == [(3, 0), (3, 0)]
    assert layout_.matching(spark, folder, schema, keys.filter("id > 5")).isEmpty()
