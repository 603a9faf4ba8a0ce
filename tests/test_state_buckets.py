"""Keys that share an entry of the state store come out as those that have their own."""

import random
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import TimerValues

from tidemark.streaming import state as ops

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, n bigint, v string, t timestamp"


def run(spark, folder, waves, salts, buckets):
    """Each wave is (key, n, value, minute) rows; gives what is held and left, and the current rows."""
    for wave in waves:
        rows = [(k, n, v, None if m is None else START + timedelta(minutes=m)) for k, n, v, m in wave]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(SCHEMA).parquet(folder + "/in")
        left = ops.latest_by_key(stream, ["k"], ["n"], "t", "10 minutes", 1200, salts, buckets)
        ops.start(left, folder + "/out", folder + "/progress").awaitTermination()
    schema = stream.schema
    seen = {
        "held": ops.held(spark, folder + "/progress", schema),
        "current": ops.current(spark, folder + "/out", folder + "/progress", schema, ["k"], ["n"]),
        **{kind: ops.emitted(spark, folder + "/out", schema, kind) for kind in (ops.CLOSED, ops.LATE)},
    }
    return {name: sorted(map(tuple, df.collect()), key=str) for name, df in seen.items()}


def test_a_bucket_costs_as_many_calls_as_a_key():
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
            return lambda *args: calls.append((name, *args))

    own = ops._LatestOfMany(["k"], ["n"], 10)
    own.init(Handle())

    def packed(k, n, at):
        return Row("_bucket", "rows")(0, ops._packed(pa.table({"k": pa.array(k, pa.int64()), "n": pa.array(n, pa.int64()), "_at": pa.array(at, pa.int64())})))

    timer = TimerValues(-1, 100)
    first = packed([*range(5000), 7, None], [1] * 5000 + [2, None], [100 + i for i in range(5000)] + [9999, None])
    assert list(own.handleInputRows((0,), iter([first, packed([None], [4], [101])]), timer)) == []
    assert calls == ["get", "update", ("registerTimer", 110)]
    held = ops._unpacked(own.latest.value[0]).to_pylist()
    assert len(held) == 5001 and {"k": 7, "n": 2, "_at": 9999} in held and {"k": None, "n": 4, "_at": 101} in held
    # Rows behind the watermark come out; a bucket that gets nothing else is not written.
    calls.clear()
    late = list(own.handleInputRows((0,), iter([packed([1], [9], [99])]), timer))
    assert [(ops._unpacked(r.rows).to_pylist(), r[ops.KIND]) for r in late] == [([{"k": 1, "n": 9, "_at": 99}], ops.LATE)]
    assert calls == ["get"]
    # Of all keys those that are idle close, and the timer moves to the next; a time that is the watermark has passed.
    calls.clear()
    closed = list(own.handleExpiredTimer((0,), TimerValues(-1, 111), None))
    assert [sorted(ops._unpacked(r.rows).column("_at").to_pylist()) for r in closed] == [[100, 101, 101]]
    assert calls == ["get", "update", ("registerTimer", 112)]


@pytest.mark.parametrize("salts", [1, 3])
def test_buckets_change_nothing(spark, folder, salts):
    rng = random.Random(salts)
    waves, n = [], 0
    for at in (0, 40, 80):
        wave = []
        for _ in range(150):
            n += 1
            wave.append((rng.choice([None, *(f"k{i}" for i in range(30))]), rng.choice([None, n, -n]), f"v{n}",
                         rng.choice([None, *range(at, at + 70)])))
        waves.append(wave + [(f"new{at}", n, "last", at + 70)])
    # One of several rows without order is as good as another, so only the first of a key has none.
    for wave in waves:
        for i, (k, m, v, t) in enumerate(wave):
            wave[i] = (k, m if m is not None or k == "k0" else i * 1000, v if m is not None or k != "k0" else "none", t)
    alone = run(spark, folder + "/a", waves, salts, buckets=0)
    assert run(spark, folder + "/b", waves, salts, buckets=7) == alone
    assert all(len(alone[x]) > 4 for x in ("held", "closed", "late", "current"))


def test_nested_keys_have_entries_of_their_own(spark, folder):
    schema = "k struct<a: int>, n double, t timestamp"
    spark.createDataFrame([((1,), 1.0, START), ((1,), 2.0, START), (None, 1.0, START)], schema).write.parquet(folder + "/in")
    stream = spark.readStream.schema(schema).parquet(folder + "/in")
    ops.start(ops.latest_by_key(stream, ["k"], ["n"], "t", "1 minute", 60), folder + "/out", folder + "/progress").awaitTermination()
    held = ops.held(spark, folder + "/progress", stream.schema).collect()
    assert sorted((str(r.k), r.n) for r in held) == [("None", 1.0), ("Row(a=1)", 2.0)]


def test_only_plain_texts_share_entries():
    assert ops._is_plain(ops.T.StringType()) and ops._is_plain(ops.T.LongType())
    assert not any(map(ops._is_plain, (ops.T.StringType("UTF8_LCASE"), ops.T.DoubleType(), ops.T.StructType())))
