"""Tables that remember themselves: the fold of their log, and reading by it."""

import datetime
import glob

import pytest
from pyspark.sql import functions as F

from tidemark.functions.transforms import PartitionField
from tidemark.operators import metadata
from tidemark.operators.layout import SortField
from tidemark.sources.tables import Refused, TableStore, change, changes_frame

from .plans import final

V1, V2, V3 = "240101_000000_a", "240102_000000_b", "240103_000000_c"


def state_of(spark, *changes, as_of=None):
    asked = None if as_of is None else spark.createDataFrame([("t", as_of)], "table_name string, as_of string")
    return metadata.states(changes_frame(spark, changes), asked).first()


def columns(state):
    return [(c.field_id, c.name, c.type) for c in state.columns]


BASE = [change("t", V1, "create"), change("t", V1, "add", "a", "int"), change("t", V1, "add", "s", "struct<x:int, l:array<struct<y:int>>>"),
        change("t", V1, "add_partition", "a", transform="bucket", param=4), change("t", V1, "add_partition", "a", transform="truncate", param=10)]


def test_state_after_changes(spark):
    state = state_of(
        spark, *BASE, change("t", V2, "rename", "a", "b"), change("t", V2, "widen", "b", "LONG"), change("t", V2, "drop", "s"),
        change("t", V2, "add", "s", "string"), change("t", V2, "comment", "s", "again"), change("t", V2, "drop_partition", "a_bucket_4"),
        change("t", V3, "order_by", "b", descending=True), change("t", V3, "set", "k", "1"), change("t", V3, "set", "k", "2"))
    assert columns(state) == [(1, "b", "bigint"), (6, "s", "string")] and state.last_id == 6 and not state.refused
    assert state.columns[1].comment == "again" and state.properties == {"k": "2"} and state.version == V3
    # The partition fields of the first version make one spec, and follow their column when it is renamed.
    assert [[(f.source_id, f.name) for f in spec] for spec in state.specs] == [[(1, "a_bucket_4"), (1, "a_truncate_10")], [(1, "a_truncate_10")]]
    assert [(o.source_id, o.descending, o.nulls_first) for o in state.write_order] == [(1, True, False)]


@pytest.mark.parametrize("bad, reason", [
    (change("t", V2, "create"), "the table exists"), (change("t", V2, "add", "a", "int"), "column a exists"),
    (change("t", V2, "drop", "x"), "no column x"), (change("t", V2, "drop", "a"), "part of the layout"),
    (change("t", V2, "rename", "a", "s"), "column s exists"), (change("t", V2, "rename", "a", None), "name is missing"),
    (change("t", V2, "widen", "a", "float"), "does not widen"), (change("t", V2, "widen", "a", None), "does not widen"),
    (change("t", V2, "add_partition", "a", transform="bucket", param=4), "exists"), (change("t", V2, "drop_partition", "x"), "no partition field"),
    (change("t", V2, "order_by", "x"), "no column"), (change("t", V2, "paint", "a"), "unknown change"), (change("t", V2, "add", "n"), "needs a type"),
])
def test_refused_changes_leave_the_state(spark, bad, reason):
    state, before = state_of(spark, *BASE, bad), state_of(spark, *BASE)
    assert [reason in r.reason for r in state.refused] == [True]
    assert {k: v for k, v in state.asDict().items() if k != "refused"} == {k: v for k, v in before.asDict().items() if k != "refused"}


def test_decimals_and_floats_widen(spark):
    grown = [change("t", V1, "create"), change("t", V1, "add", "d", "decimal(9, 2)"), change("t", V1, "add", "f", "float"),
             change("t", V2, "widen", "d", "decimal(12,2)"), change("t", V2, "widen", "f", "double"), change("t", V3, "widen", "d", "decimal(12,3)")]
    state = state_of(spark, *grown)
    assert columns(state) == [(1, "d", "decimal(12,2)"), (2, "f", "double")] and len(state.refused) == 1


def test_a_table_made_again_goes_on_counting(spark):
    state = state_of(spark, *BASE, change("t", V2, "drop_table"), change("t", V2, "add", "z", "int"), change("t", V3, "create"), change("t", V3, "add", "a", "date"))
    assert columns(state) == [(6, "a", "date")] and [r.reason for r in state.refused] == ["no such table"]
    gone = state_of(spark, *BASE, change("t", V2, "drop_table"))
    assert not gone.is_there


@pytest.mark.parametrize("as_of, names", [("231231", []), ("240101_000000", ["a", "s"]), (V2 + "zzz", ["b", "s"]), ("240102_235959_x", ["b", "s"]), ("249999", ["b", "s", "c"])])
def test_as_of(spark, as_of, names):
    log = [*BASE, change("t", V2, "rename", "a", "b"), change("t", V3, "add", "c", "int")]
    state = state_of(spark, *log, as_of=as_of)
    assert [c.name for c in state.columns] == names and state.as_of == as_of and state.is_there == bool(names)


def test_many_tables_and_a_hot_one(spark):
    """Rows of many tables in any order; one table has half of them."""
    hot = [("hot", V1, i + 1, "add", f"c{i}", "int") for i in range(2000)]
    rest = [(f"t{i % 500}", V1, 2 + i // 500, "add", f"c{i}", "int") for i in range(2000)]
    made = [("hot", V1, 0, "create", None, None)] + [(f"t{i}", V1, 1, "create", None, None) for i in range(500)]
    odd = [(None, V1, 1, "create", None, None), ("x", None, 1, "create", None, None), ("x", V1, None, "create", None, None)]
    log = spark.createDataFrame([*rest, *hot, *made, *odd], "table_name string, version string, seq long, kind string, name string, value string")
    got = {r.table_name: r for r in metadata.states(log.repartition(5)).collect()}
    assert len(got) == 501 and got["hot"].last_id == 2000 and all(got[f"t{i}"].last_id == 4 and not got[f"t{i}"].refused for i in range(500))
    assert metadata.states(log.limit(0)).count() == 0


def test_refused_changes_are_counted_or_told_one_by_one(spark):
    """A state holds one number per kind, however many changes were refused; the changes themselves are rows."""
    again = [("t", V1, i, "create", None, None) for i in range(2000)] + [("t", V1, 2000 + i, "what", None, None) for i in range(3)]
    again += [("t", V2, 2010, "drop", "a", None), ("u", V2, 0, "add", "a", "int")]
    log = spark.createDataFrame(again, "table_name string, version string, seq long, kind string, name string, value string").repartition(5)
    got = {r.table_name: r for r in metadata.counted_states(log).collect()}
    assert got["t"].n_refused == {"create": 1999, "unknown": 3, "drop": 1} and got["t"].is_there and got["t"].version == V1
    assert got["u"].n_refused == {"add": 1} and not got["u"].is_there
    told = {(r.table_name, r.seq): (r.version, r.reason) for r in metadata.refusals(log).collect()}
    listed = {(s.table_name, r.seq): (r.version, r.reason) for s in metadata.states(log).collect() for r in s.refused}
    assert told == listed and len(told) == 2004
    asked = spark.createDataFrame([("t", V1), ("t", V2)], "table_name string, as_of string")
    assert {r.as_of: sum(r.n_refused.values()) for r in metadata.counted_states(log, asked).collect()} == {V1: 2002, V2: 2003}


def test_store(spark, folder):
    store = TableStore(spark, folder)
    assert not store.exists("t") and store.states().count() == 0
    create = dict(columns={"id": "long", "day": "date", "s": "struct<x:int>"}, comments={"day": "of birth"}, partitions=[PartitionField("months", "day")],
                  order=[SortField(PartitionField("identity", "id"))], properties={"owner": "me"})
    assert store.create_if_absent("t", V1, **create)
    assert not store.create_if_absent("t", V2, columns={"other": "int"})
    with pytest.raises(Refused, match="the table exists"):
        store.create("t", V2, {"other": "int"})
    t = TableStore(spark, folder).open("t")
    assert t.schema.columns["day"].metadata["comment"] == "of birth" and t.properties == {"owner": "me"} and t.schema.last_id == 4
    day = datetime.date
    t.append(spark.createDataFrame([(1, day(2024, 1, 1), (5,)), (2, day(2024, 2, 1), None)], "id int, day date, s struct<x:int>"))
    # All or none: the second change is refused, so the first is not stored either.
    with pytest.raises(Refused, match="no column nothing"):
        store.record(changes_frame(spark, [change("t", V2, "add", "n", "int"), change("t", V2, "drop", "nothing")]))
    assert store.open("t").schema.names == ["id", "day", "s"]
    store.record(changes_frame(spark, [change("t", V2, "rename", "day", "born"), change("t", V2, "drop", "s"), change("t", V2, "add", "s", "string"),
                                       change("t", V2, "add_partition", "born", "born_day", "days")]))
    TableStore(spark, folder).open("t").append(spark.createDataFrame([(3, day(2024, 2, 2), "z"), (4, None, None)], "id int, born date, s string"))
    again = TableStore(spark, folder).open("t")
    rows = sorted((tuple(r) for r in again.read().collect()))
    assert rows == [(1, day(2024, 1, 1), None), (2, day(2024, 2, 1), None), (3, day(2024, 2, 2), "z"), (4, None, None)]
    assert sorted({p.split("/")[-3] for p in glob.glob(f"{folder}/data/t/*/*/*.parquet")}) == ["spec=0"]
    assert glob.glob(f"{folder}/data/t/spec=1/*/born_day=*/*.parquet")
    # As of the first version the table has its old columns, and reads files of both ages by them.
    old = TableStore(spark, folder).open("t", as_of=V1)
    assert sorted((r.id, r.day, r.s) for r in old.read().collect())[0] == (1, day(2024, 1, 1), (5,))


def test_reads_are_pruned_per_spec(spark, folder):
    store = TableStore(spark, folder)
    store.create("t", V1, {"id": "long", "day": "date"}, partitions=[PartitionField("months", "day")])
    rows = spark.range(366).select("id", F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"))
    store.open("t").append(rows)
    store.record(changes_frame(spark, [change("t", V2, "drop_partition", "day_months"), change("t", V2, "add_partition", "day", transform="days")]))
    store.open("t").append(rows)
    found = store.open("t").read_between("day", F.lit("2024-03-05"), F.lit("2024-03-06"))
    assert found.count() == 4
    plan = final(found)
    assert "isnull(day_months" not in plan and plan.count("PartitionFilters: [isnotnull(day_") == 2
    files = {r.f.split("/")[-3:-1][1] for r in found.select(F.input_file_name().alias("f")).collect()}
    assert files == {"day_months=650", "day_days=19787", "day_days=19788"}


def test_a_refused_step_down_forgets_nothing(spark, folder):
    store, forgotten = TableStore(spark, folder), []
    store.create("t", V1, {"a": "int"})
    store.record(changes_frame(spark, [change("t", V2, "widen", "a", "long"), change("t", V2, "add", "b", "int")]))
    before = store.log().count()
    with pytest.raises(Refused, match="does not widen"):
        store.step_down(V2, changes_frame(spark, [change("t", V2, "drop", "b"), change("t", V2, "widen", "a", "int")]), lambda: forgotten.append(1))
    assert not forgotten and store.log().count() == before
    store.step_down(V2, changes_frame(spark, [change("t", V2, "drop", "b")]), lambda: forgotten.append(1))
    assert forgotten == [1] and store.open("t").schema.names == ["a"]
