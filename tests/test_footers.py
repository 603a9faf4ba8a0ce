"""Inventories of files, their drift from a schema, and backfills file by file."""

import glob

import pytest
from pyspark.sql import functions as F

from tidemark.functions.transforms import PartitionField
from tidemark.operators.schema import SchemaChange, change_schema_to, declare, write_generation
from tidemark.sources.footers import drift_of_files, file_inventory
from tidemark.sources.tables import TableStore, change, changes_frame

V1, V2 = "240101_000000_a", "240102_000000_b"


def test_inventory_and_drift(spark, folder):
    old = declare({"id": "int", "at": "timestamp_ntz", "gone": "string", "s": "struct<x:int>", "d": "decimal(9,2)"})
    new = change_schema_to(old, [(V1, SchemaChange("rename", "at", new_name="seen")), (V1, SchemaChange("widen", "id", "long")),
                                 (V1, SchemaChange("drop", "gone")), (V1, SchemaChange("add", "more", "date"))])
    rows = spark.range(10).select("id", F.current_timestamp().alias("at"), F.lit("g").alias("gone"))
    write_generation(rows.coalesce(1), old, f"{folder}/gen=0")
    write_generation(rows.withColumnRenamed("at", "seen").coalesce(1), new, f"{folder}/gen=1")
    (spark.range(3).coalesce(1).write.parquet(f"{folder}/gen=2"))
    held = file_inventory(spark, folder)
    first = {r.column_name: (r.field_id, r.column_type, r.n_rows) for r in held.filter(F.contains("file", F.lit("gen=0"))).collect()}
    assert first == {"id": (1, "int", 10), "at": (2, "timestamp_ntz", 10), "gone": (3, "string", 10), "s": (5, "struct<x:int>", 10), "d": (6, "decimal(9,2)", 10)}
    drift = {(r.file.split("gen=")[1][0], r.change, r.file_name, r.column_name) for r in drift_of_files(held, new).collect()}
    assert {d for d in drift if d[0] != "2"} == {("0", "retyped", "id", "id"), ("0", "renamed", "at", "seen"), ("0", "dropped", "gone", None), ("0", "added", None, "more")}
    assert ("2", "unnumbered", "id", None) in drift and len(drift) == 10
    assert file_inventory(spark, f"{folder}/nothing").count() == 0


def test_backfill_rewrites_what_differs_and_goes_on(spark, folder, monkeypatch):
    store = TableStore(spark, folder)
    store.create("t", V1, {"id": "int", "kind": "string"}, partitions=[PartitionField("identity", "kind", name="k")])
    rows = spark.range(40).select("id", F.concat(F.lit("a"), F.col("id") % 4).alias("kind"))
    store.open("t").append(rows)
    store.record(changes_frame(spark, [change("t", V2, "widen", "id", "long"), change("t", V2, "add", "n", "int")]))
    store.open("t").append(rows.select((F.col("id") + 100).alias("id"), "kind", F.lit(1).alias("n")))
    before = sorted(map(str, store.open("t").read().collect()))
    fresh = set(glob.glob(f"{folder}/data/t/spec=*/**/*.parquet", recursive=True))

    # A run that breaks off before it is recorded changes nothing.
    monkeypatch.setattr(TableStore, "record", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.backfill("t", V2)
    monkeypatch.undo()
    assert sorted(map(str, TableStore(spark, folder).open("t").read().collect())) == before

    done, left = store.backfill("t", V2, most_bytes=1)
    assert (done, left) == (1, 3) and sorted(map(str, store.open("t").read().collect())) == before
    assert TableStore(spark, folder).backfill("t", V2) == (3, 0) and store.backfill("t", V2) == (0, 0)
    again = TableStore(spark, folder).open("t")
    assert sorted(map(str, again.read().collect())) == before
    assert again.read_between("kind", F.lit("a1"), F.lit("a2")).count() == 40
    # Files of the second version were not touched, and no old one is gone.
    assert fresh == set(glob.glob(f"{folder}/data/t/spec=*/**/*.parquet", recursive=True))
    assert len(again.fills) == 2 and sum(spark.read.parquet(f"{folder}/data/t/fill={f}/spec=0").filter("id < 100").count() for f in again.fills) == 40


def test_backfill_under_a_new_spec(spark, folder):
    store = TableStore(spark, folder)
    store.create("t", V1, {"id": "int"})
    store.open("t").append(spark.range(20).coalesce(1))
    store.record(changes_frame(spark, [change("t", V2, "add_partition", "id", "part", "truncate", 10)]))
    assert store.backfill("t", V2) == (1, 0)
    assert store.open("t").read().count() == 20 and store.backfill("t", V2) == (0, 0)
    assert len(glob.glob(f"{folder}/data/t/fill=*/spec=1/part=*")) == 2
