"""Rules that the registered queries do not reach: NULL keys, missing images, spellings, evolved layouts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.datatypes import type_change
from tidemark.operators import changes as ch
from tidemark.operators import ledger_state as state
from tidemark.operators.layout import Layout, PartitionField, between, equal_to
from tidemark.plans import steps
from tidemark.sources.ledger import from_properties
from tidemark.sources.scripts import scan_scripts

from .conftest import SF_DIR


@pytest.fixture
def keyed(spark):
    defined = spark.createDataFrame([(None, "240101_000000_a"), ("s", "240101_000000_a"), ("s", None)], "scope string, version string")
    return defined, defined.filter("scope IS NULL OR version IS NULL")


def test_a_null_key_is_applied_or_pending_but_not_both(keyed):
    defined, done = keyed
    assert [tuple(r) for r in state.pending(defined, done).collect()] == [("s", "240101_000000_a")]
    assert {(r.scope, r.version): r.is_applied for r in state.exists(defined, done).collect()} == {
        (None, "240101_000000_a"): True, ("s", "240101_000000_a"): False, ("s", None): True}
    assert {r.scope: (r.n_applied, r.n_cancelled) for r in steps.apply_report(defined, done).collect()} == {
        None: (1, 0), "s": (1, 1)}


def test_newest_batch_of_a_null_scope(spark):
    rows = [(None, "a", 1), (None, "b", 2), ("s", "a", 2), ("s", "b", 2), ("t", "a", None)]
    done = spark.createDataFrame(rows, "scope string, version string, apply_time long")
    got = {(r.scope, r.version) for r in state.latest_batch_per_scope(done).collect()}
    assert got == {(None, "b"), ("s", "a"), ("s", "b")}


@pytest.mark.parametrize("column,act", [("before", ch.revert_changes), ("after", ch.apply_changes)])
def test_a_missing_image_fails(spark, column, act):
    table = spark.createDataFrame([(1, 10)], "id long, v long")
    image = "struct<id:bigint,v:bigint>"
    change = spark.createDataFrame([(1, "240101_000000_a", 1, "update")], "id long, version string, seq long, op string")
    change = change.withColumns({"before": F.lit(None).cast(image), "after": F.lit(None).cast(image)})
    with pytest.raises(Exception, match=f"no image {column}"):
        act(table, change, ["id"]).collect()


@pytest.mark.parametrize("old,new,verdict", [
    ("int", "long", "widen"), ("INT", "BIGINT", "widen"), ("integer", "int", "same"), (" Decimal(9, 2)", "decimal(12,2)", "widen"),
    ("long", "int", "refuse"), ("decimal(9,2)", "decimal(12,3)", "refuse"), ("Float", "double", "widen"),
])
def test_written_types_compare_by_meaning(spark, old, new, verdict):
    row = spark.createDataFrame([(old, new)], "old string, new string")
    assert row.select(type_change("old", "new")).first()[0] == verdict


@pytest.mark.parametrize("value", [" 12 ", "", "1.0", "12x", "12\n"])
def test_property_values_are_whole_numbers(spark, value):
    bag = spark.createDataFrame([({"migrate.v": value},)], "properties map<string,string>")
    with pytest.raises(Exception, match="no integer"):
        from_properties(bag).collect()


def test_a_bad_script_name_fails_whatever_is_read(spark, folder):
    with open(f"{folder}/nonsense.up.sql", "w") as script:
        script.write("SELECT 1")
    with pytest.raises(Exception, match="bad script name"):
        scan_scripts(spark, folder).select("body").collect()
    with pytest.raises(Exception, match="bad script name"):
        scan_scripts(spark, folder).count()


def test_pruned_reads_of_an_evolved_layout_keep_older_files(spark, folder):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    first, second = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    old = Layout((( ),))
    old.write(first, folder)
    new = old.add(PartitionField("days", "ts")).add(PartitionField("bucket", "user_id", 8))
    new.write(second, folder)
    table = new.read(spark, folder, events.schema)
    user = events.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    assert equal_to(table, events.schema, new.current, "user_id", user).count() == events.filter(F.col("user_id") == user).count()
    low, high = F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz")
    got = between(table, events.schema, new.current, "ts", low, high).count()
    assert got == events.filter(F.col("ts").between(low, high)).count() > 0
