"""Latest rows in the state store: one row a key, idle keys close, late rows come out."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import TimerValues

from tidemark.streaming import state as ops

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, n bigint, v string, t timestamp"


def run(spark, folder, waves, delay="10 minutes", keep=1800, salts=1):
    """Each wave is (key, n, value, minute) rows; gives sets of (k, n, v) held and left, and the current rows."""
    for i, wave in enumerate(waves):
        rows = [(k, n, v, None if m is None else START + timedelta(minutes=m)) for k, n, v, m in wave]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(SCHEMA).parquet(folder + "/in")
        left = ops.latest_by_key(stream, ["k"], ["n"], "t", delay, keep, salts)
        ops.start(left, folder + "/out", folder + "/progress").awaitTermination()
    schema = stream.schema
    seen = {
        "held": ops.held(spark, folder + "/progress", stream.schema),
        "current": ops.current(spark, folder + "/out", folder + "/progress", stream.schema, ["k"], ["n"]),
        **{kind: ops.emitted(spark, folder + "/out", schema, kind) for kind in (ops.CLOSED, ops.LATE)},
    }
    return {name: sorted(((r.k, r.n, r.v) for r in df.collect()), key=str) for name, df in seen.items()}


def test_idle_keys_close_and_late_rows_come_out(spark, folder):
    got = run(spark, folder, [
        [("a", 1, "x", 0), ("a", 2, "y", 1), ("b", 5, "z", 60), (None, 1, "none", 60), ("c", 1, "untimed", None)],
        # The watermark is at minute 50: minute 49 is late, minute 50 is not; "a" closed after minute 31.
        [("b", 9, "late", 49), ("b", 4, "older", 50), ("a", 3, "again", 61), ("b", None, "no order", 61)],
    ])
    assert got["late"] == [("b", 9, "late")]
    assert got["closed"] == [("a", 2, "y")]
    assert got["held"] == sorted([("a", 3, "again"), ("b", 5, "z"), (None, 1, "none"), ("c", 1, "untimed")], key=str)
    assert got["current"] == got["held"]


def test_state_is_bounded_and_hot_keys_are_salted(spark, folder):
    # A new key a minute over three waves, beside one key with as many rows as all others.
    waves = [[r for m in range(w * 120, w * 120 + 120) for r in ((f"k{m}", m, "v", m), ("hot", m, f"v{m}", m))] for w in range(3)]
    got = run(spark, folder, waves, keep=600, salts=3)
    # Keep and delay span 20 minutes: so many keys, and the states of the hot one.
    assert len([k for k, *_ in got["held"] if k != "hot"]) <= 21
    assert 1 <= len([k for k, *_ in got["held"] if k == "hot"]) <= 3
    assert got["late"] == []
    assert len(got["current"]) == 361 and ("hot", 359, "v359") in got["current"]


def test_settings_are_left_alone(spark, folder):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run(spark, folder, [[("a", 1, "x", 0)]])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


@pytest.mark.parametrize("salts", [1, 2])
def test_a_second_run_without_rows_changes_nothing(spark, folder, salts):
    one = run(spark, folder, [[("a", 1, "x", 0)]], salts=salts)
    left = ops.latest_by_key(spark.readStream.schema(SCHEMA).parquet(folder + "/in"), ["k"], ["n"], "t", "10 minutes", 1800, salts)
    ops.start(left, folder + "/out", folder + "/progress").awaitTermination()
    held = ops.held(spark, folder + "/progress", spark.read.parquet(folder + "/in").schema)
    assert [tuple(r)[:3] for r in held.collect()] == one["held"] == [("a", 1, "x")]
    assert held.filter("t = timestamp'2024-01-01 00:00:00'").count() == 1


def test_a_key_costs_few_calls():
    """Each call of the handle goes to the JVM and back: one reads, one writes, one sets the timer."""
    calls = []

    class Handle:
        value = None

        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = Row(*value)

        def __getattr__(self, name):
            return lambda *args: calls.append(name)

    own = ops._Latest(T.StructType().add("k", "string").add("n", "long"), ["n"], 10)
    own.init(Handle())
    row, timer = Row("_at", "k", "n"), TimerValues(-1, 100)
    assert list(own.handleInputRows(("a",), iter([row(100, "a", 1), row(101, "a", 3), row(102, "a", 2)]), timer)) == []
    assert calls == ["get", "update", "registerTimer"] and tuple(own.latest.value) == ("a", 3, 101)
    assert [tuple(r) for r in own.handleInputRows(("a",), iter([row(99, "a", 9)]), timer)] == [("a", 9, ops.LATE)]
    calls.clear()
    closed = list(own.handleExpiredTimer(("a",), timer, None))
    assert [r.asDict() for r in closed] == [{"k": "a", "n": 3, ops.KIND: ops.CLOSED}] and calls == ["get", "clear"]
    own.latest.value = None
    assert list(own.handleExpiredTimer(("a",), timer, None)) == []
