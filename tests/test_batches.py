import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes as ops
from tidemark.sources import batches, files, scripts
from tidemark.sources.batches import LEDGER, AlreadyApplied, BatchStore, NotApplied, Refused
from tidemark.sources.ledger import ROWS

ROW = "id bigint, v string"


@pytest.fixture
def store(spark, folder):
    return BatchStore(spark, folder + "/store")


def rows(spark, *ids, v="x"):
    return spark.createDataFrame([(i, v) for i in ids], ROW)


def versions(spark, *names):
    return spark.createDataFrame([("s", n) for n in names], "scope string, version string")


def ids(store, table="t"):
    return sorted(r.id for r in store.read(table, ROW).collect())


def test_staged_rows_are_invisible(spark, store):
    store.stage("t", rows(spark, 1), "b1")
    assert ids(store) == [] and store.applied().isEmpty()
    store.commit(["b1"], 5)
    assert ids(store) == [1]


def test_release_is_all_or_nothing(spark, store):
    store.release(versions(spark, "a"), {"t": rows(spark, 1), "u": rows(spark, 7)}, {"t": ["id"]}, 10)
    with pytest.raises(Refused, match="twice"):
        store.release(versions(spark, "b", "c"), {"u": rows(spark, 8), "t": rows(spark, 2, 2)}, {"t": ["id"]}, 20)
    with pytest.raises(Refused, match="published"):
        store.release(versions(spark, "b", "c"), {"u": rows(spark, 8), "t": rows(spark, 1)}, {"t": ["id"]}, 20)
    assert ids(store) == [1] and ids(store, "u") == [7]
    assert [r.version for r in store.applied().collect()] == ["a"]


def test_release_shares_one_time_and_rolls_back_as_one(spark, store):
    store.release(versions(spark, "a"), {"t": rows(spark, 1)}, apply_time=10)
    batch = store.release(versions(spark, "b", "c"), {"t": rows(spark, 2, 3)}, apply_time=20)
    assert sorted((r.version, r.apply_time) for r in store.applied().collect()) == [("a", 10), ("b", 20), ("c", 20)]
    with pytest.raises(Refused, match="counterpart"):
        store.rollback(versions(spark, "b"))
    assert ids(store) == [1, 2, 3]
    assert store.rollback(versions(spark, "b", "c")) == [batch]
    assert ids(store) == [1] and [r.version for r in store.applied().collect()] == ["a"]
    store.commit([batch], 30)
    assert ids(store) == [1, 2, 3], "a withdrawn batch can be applied again"


def test_applying_and_reverting_twice(spark, store):
    store.release(versions(spark, "a"), {"t": rows(spark, 1)}, apply_time=10, batch_id="b1")
    with pytest.raises(AlreadyApplied):
        store.commit(["b1"], 11)
    with pytest.raises(AlreadyApplied):
        store.release(versions(spark, "a"), {"t": rows(spark, 1)}, apply_time=12)
    assert store.commit(["b1"], 11, strict=False) == []
    with pytest.raises(NotApplied):
        store.withdraw(["b2"])
    store.withdraw(["b1"])
    with pytest.raises(NotApplied):
        store.withdraw(["b1"])
    assert store.rollback() == []


def test_best_effort_keeps_the_versions_before_the_failure(spark, store):
    for i, batch in enumerate((rows(spark, 1), rows(spark, 1), rows(spark, 3))):
        store.stage("t", batch, f"b{i}")
    done, error = store.apply_each(["b0", "b1", "b2"], "t", rows(spark, 1).schema, ["id"], 10)
    assert done == ["b0"] and "published" in error and ids(store) == [1]


def test_two_writers_do_not_share_a_commit(spark, folder):
    path = folder + "/commits/1.json"
    assert files.create_once(spark, path, "first") and not files.create_once(spark, path, "second")
    assert open(path).read() == "first"


def overtaken(store, name, rival):
    """Let ``rival`` run once, after the store's method ``name``."""
    method = getattr(store, name)

    def run(*args, **kwargs):
        result = method(*args, **kwargs)
        setattr(store, name, method)
        rival()
        return result

    setattr(store, name, run)


def test_a_release_that_was_overtaken_is_refused(spark, store):
    rival = BatchStore(spark, store.path)

    def release(where):
        return where.release(versions(spark, "a"), {"t": rows(spark, 1)}, {"t": ["id"]}, 10)

    overtaken(store, "check_unique", lambda: release(rival))
    with pytest.raises(Refused, match="start over"):
        release(store)
    assert ids(store) == [1] and [r.version for r in store.applied().collect()] == ["a"]
    with pytest.raises(AlreadyApplied):
        release(store)


def test_a_rollback_that_was_overtaken_is_refused(spark, store):
    store.release(versions(spark, "a"), {"t": rows(spark, 1)}, apply_time=10)
    rival = BatchStore(spark, store.path)
    overtaken(store, "newest", lambda: rival.release(versions(spark, "b"), {"t": rows(spark, 2)}, apply_time=20))
    with pytest.raises(Refused, match="start over"):
        store.rollback()
    assert ids(store) == [1, 2]
    store.rollback()
    assert ids(store) == [1]


def test_best_effort_stops_when_it_was_overtaken(spark, store):
    schema = rows(spark).schema
    for n in (1, 2):
        store.stage("t", rows(spark, n), f"b{n}")
    rival = BatchStore(spark, store.path)
    overtaken(store, "check_unique", lambda: rival.release(versions(spark, "r"), {"t": rows(spark, 1)}, {"t": ["id"]}, 5))
    done, error = store.apply_each(["b1", "b2"], "t", schema, ["id"], 10)
    assert done == [] and "start over" in error and ids(store) == [1]


def test_a_broken_commit_file_is_ignored(spark, store, folder):
    store.stage("t", rows(spark, 1), "b1")
    files.create_once(spark, folder + "/store/commits/00000001.json", "")
    whole = '{"n": 2, "entries": [{"batch_id": "b1", "apply_time": 1, "live": true}, {"batch_id": "b2"'
    files.create_once(spark, folder + "/store/commits/00000002.json", whole)
    assert ids(store) == []
    store.commit(["b1"], 5)
    assert ids(store) == [1] and "00000003.json" in files.names(spark, folder + "/store/commits")


def test_few_ids_prune_and_many_ids_join(spark, store, monkeypatch):
    for i in range(4):
        store.stage("t", rows(spark, i), f"b{i}")
    store.commit(["b0", "b2"], 5)
    plan = store.read("t", ROW)._jdf.queryExecution().executedPlan().toString()
    assert "batch_id" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Join" not in plan
    monkeypatch.setattr(batches, "LITERAL_IDS", 1)
    assert sorted(r.id for r in store.of_batches("t", ROW, ["b0", "b3"]).collect()) == [0, 3]
    assert "Join" in store.read("t", ROW)._jdf.queryExecution().executedPlan().toString()
    assert ids(store) == [0, 2]


def test_ledger_rows_of_a_batch(spark, store):
    store.release(versions(spark, "a"), {}, apply_time=10, batch_id="b1")
    assert store.staged(LEDGER, ROWS).select("batch_id").first().batch_id == "b1"


BASE = [(1, "a"), (2, "b"), (3, "c")]
CHANGES = [
    (1, "v1", 1, "update", (1, "a"), (1, "A")), (2, "v1", 2, "delete", (2, "b"), None),
    (4, "v2", 3, "insert", None, (4, "d")), (2, "v2", 4, "insert", None, (2, "B")),
    (4, "v3", 5, "delete", (4, "d"), None), (1, "v3", 6, "update", (1, "A"), (1, "AA")),
]


def change_frames(spark):
    base = spark.createDataFrame(BASE, ROW)
    return base, spark.createDataFrame(CHANGES, ops.change_schema(base.schema, ["id"]))


def content(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("version, expected", [
    ("v0", BASE), ("v1", [(1, "A"), (3, "c")]), ("v2", [(1, "A"), (2, "B"), (3, "c"), (4, "d")]),
    ("v3", [(1, "AA"), (2, "B"), (3, "c")]),
])
def test_every_version_can_be_reached_both_ways(spark, version, expected):
    base, changes = change_frames(spark)
    assert content(ops.table_as_of(base, changes, ["id"], version)) == sorted(expected)
    now = ops.apply_changes(base, changes, ["id"])
    assert content(ops.revert_changes(now, ops.after(changes, version), ["id"])) == sorted(expected)
    assert content(ops.redo(now, changes, ["id"], 2)) == content(now)


def test_irreversible_changes(spark):
    _, changes = change_frames(spark)
    assert ops.irreversible(changes).isEmpty()
    blind = changes.withColumn("before", F.lit(None).cast(changes.schema["before"].dataType))
    assert ops.irreversible(blind).count() == 4


def test_small_change_sets_do_not_shuffle_the_table(spark):
    base, changes = change_frames(spark)
    plan = ops.apply_changes(base, changes, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_scripts(spark, folder):
    for name, body in [("240101_000000_aa.up.sql", "a;"), ("240101_000000_aa.down.sql", "b;"),
                       ("240102_000000_bb.safe.up.sql", "c"), ("240102_000000_bb.up.sql", "d")]:
        (open(f"{folder}/{name}", "w")).write(body)
    up = scripts.scan_scripts(spark, folder)
    assert sorted((r.version, r.safe, r.body) for r in up.collect()) == [
        ("240101_000000_aa", False, "a;"), ("240102_000000_bb", False, "d"), ("240102_000000_bb", True, "c")]
    assert scripts.scan_scripts(spark, folder, direction=None).count() == 4
    plain = scripts.choose_variant(up).filter("version like '%bb'").first()
    assert (plain.safe, plain.body) == (False, "d")
    assert scripts.choose_variant(up, force_safe=True).filter("version like '%bb'").first().body == "c"


def test_one_bad_script_name_fails_the_listing(spark, folder):
    for name in ("240101_000000_aa.up.sql", "2401_bad.up.sql", "notes.txt"):
        open(f"{folder}/{name}", "w").write("x")
    with pytest.raises(Exception, match="bad script name"):
        scripts.scan_scripts(spark, folder).collect()
    assert [r.version for r in scripts.scan_scripts(spark, folder, strict=False).collect()] == ["240101_000000_aa"]
    assert {r.file for r in scripts.rejected(spark, folder).collect()} == {"2401_bad.up.sql", "notes.txt"}
