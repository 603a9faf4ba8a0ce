"""Latest state per key inside the state store: one row a key, closed when idle, late rows reported."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

# Workers get the processor by value, so they need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What an emitted row is: the last state of a key that became idle, or a row behind the watermark.
CLOSED, LATE = "closed", "late"
KIND = "_kind"
#: Groups of keys that share an entry of the state store, and what of their rows is packed or merged at once.
BUCKETS, PACKED_BYTES, MERGED_ROWS = 1024, 8 << 20, 1 << 18
#: Columns that Arrow sorts and groups as Spark does; times are numbers here.
_PLAIN = (T.IntegralType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.DecimalType)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """Keeps the newest row of a key until the watermark is ``keep`` behind it."""

    def __init__(self, schema: T.StructType, order: Sequence[str], keep: int):
        self.schema, self.keep = schema, keep
        self.order = [schema.names.index(c) for c in order]
        self.output = Row(*schema.names, KIND)
        self.places = None

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", T.StructType([*self.schema.fields, T.StructField("_at", T.LongType())]))

    def _held(self) -> tuple | None:
        # Each call asks the JVM: one that gets nothing says as much as ``exists``.
        held = self.latest.get()
        return None if held is None else tuple(held)

    def _rank(self, values: Sequence) -> list:
        return [(values[i] is not None, values[i]) if values[i] is not None else (False,) for i in self.order]

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        newest = held
        for row in rows:
            if self.places is None:
                self.places = [row.__fields__.index(c) for c in (*self.schema.names, "_at")]
            values = tuple(row[i] for i in self.places)
            if values[-1] is not None and values[-1] < watermark:
                yield self._row(LATE, values)
            elif newest is None or self._rank(values) > self._rank(newest):
                newest = values
        if newest is not held:
            if held is not None and held[-1] is not None:
                self.handle.deleteTimer(held[-1] + self.keep)
            self.latest.update(newest)
            if newest[-1] is not None:
                self.handle.registerTimer(newest[-1] + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        if held is not None:
            yield self._row(CLOSED, held)
            self.latest.clear()

    def _row(self, kind: str, values: Sequence) -> Row:
        return self.output(*values[:-1], kind)

    def close(self) -> None:
        pass


def _packed(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_bucket, rows) of rows whose last column is their bucket, some megabytes at a time."""
    def flush(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(part).combine_chunks()
        buckets = table.column("_bucket").to_numpy()
        order = np.argsort(buckets, kind="stable")
        table, buckets = table.drop_columns("_bucket").take(pa.array(order)).combine_chunks(), buckets[order]
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        sizes = np.diff(np.append(starts, len(buckets)))
        rows = [_packed(table.slice(low, n)) for low, n in zip(starts.tolist(), sizes.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(buckets[starts], pa.int32()), pa.array(rows, pa.binary())], ["_bucket", "rows"])

    part, held = [], 0
    for batch in batches:
        if batch.num_rows:
            part.append(batch)
            held += batch.nbytes
        if held >= PACKED_BYTES:
            yield flush(part)
            part, held = [], 0
    if part:
        yield flush(part)


def _unpack_batches(columns: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows as rows again; a second column is their kind."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _unpacked(batch.column(0)[i].as_py()).select(columns)
                if batch.num_columns > 1:
                    rows = rows.append_column(KIND, pa.array([batch.column(1)[i].as_py()] * len(rows), pa.string()))
                yield from rows.to_batches()
    return unpack


class _LatestOfMany(StatefulProcessor):
    """What :class:`_Latest` keeps, for all keys of a bucket in one entry of packed rows and under one timer."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], keep: int):
        self.keys, self.order, self.keep = [*keys], [*order], keep
        self.output = Row("rows", KIND)

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("rows", T.BinaryType())]))

    def _held(self) -> pa.Table | None:
        held = self.latest.get()
        return None if held is None else _unpacked(bytes(tuple(held)[0]))

    def _merged(self, parts: list[pa.Table]) -> pa.Table:
        """The greatest row of each key, the first of equal ones."""
        rows = pa.concat_tables(parts)
        place = pa.array(np.arange(len(rows)))
        ranked = pa.table([*[rows.column(c) for c in self.order], place], [*[f"o{i}" for i in range(len(self.order))], "place"])
        by = pc.sort_indices(ranked, sort_keys=[*[(f"o{i}", "descending") for i in range(len(self.order))], ("place", "ascending")],
                             null_placement="at_end")
        first = pa.table([*[rows.column(c).take(by) for c in self.keys], place], [*[f"k{i}" for i in range(len(self.keys))], "rank"])
        first = first.group_by([f"k{i}" for i in range(len(self.keys))], use_threads=False).aggregate([("rank", "min")])
        # In the order of their places, as they came.
        return rows.take(pa.array(np.sort(by.to_numpy()[first.column("rank_min").to_numpy()]))).combine_chunks()

    def _due(self, rows: pa.Table | None) -> int | None:
        """When the first key of ``rows`` closes."""
        first = None if rows is None else pc.min(rows.column("_at")).as_py()
        return None if first is None else first + self.keep

    def _keep(self, rows: pa.Table, due: int | None) -> None:
        self.latest.update((_packed(rows),))
        now = self._due(rows)
        if now != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if now is not None:
                self.handle.registerTimer(now)

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        parts, waiting, came = [] if held is None else [held], 0, False
        for row in rows:
            given = _unpacked(row.rows)
            late = pc.fill_null(pc.less(given.column("_at"), watermark), False)
            if pc.any(late).as_py():
                yield self.output(_packed(given.filter(late)), LATE)
                given = given.filter(pc.invert(late))
            if len(given):
                parts, waiting, came = [*parts, given], waiting + len(given), True
            if waiting >= MERGED_ROWS:
                parts, waiting = [self._merged(parts)], 0
        if came:
            self._keep(self._merged(parts), self._due(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        if held is None:
            return
        # As timers do: one whose time is the watermark has passed.
        idle = pc.fill_null(pc.less_equal(held.column("_at"), timerValues.getCurrentWatermarkInMs() - self.keep), False)
        if pc.any(idle).as_py():
            yield self.output(_packed(held.filter(idle)), CLOSED)
            left = held.filter(pc.invert(idle))
            if len(left):
                # The timer that has just passed goes by itself.
                self._keep(left.combine_chunks(), None)
            else:
                self.latest.clear()

    def close(self) -> None:
        pass


def latest_by_key(stream: DataFrame, keys: Sequence[str], order: Sequence[str], event_time: str, delay: str,
                  keep_seconds: int, salts: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows that leave the state of a stream, with their ``_kind``: ``closed`` or ``late``.

    The state holds the row of each key that is greatest by ``order`` (NULL first), whatever number of rows and epochs
    came before. A key leaves it, as ``closed``, when the watermark (the greatest event time less ``delay``) has passed
    the time of its row by ``keep_seconds``; so the state is bounded by the keys of that span. A row whose time is
    behind the watermark when it arrives changes no state and comes out as ``late``, where a plain watermark would drop it
    unseen. Rows without a time are never late and their keys never close. NULL keys are a key.

    With ``salts`` above 1 a key has up to that many states, chosen by the row's hash, so a key with much of the stream
    spreads over tasks; :func:`current` merges them.

    Keys are dealt over ``buckets`` by their hash, and those of a bucket share one entry of the state store, so an epoch costs calls
    by bucket and not by key; it reads and writes the whole of each bucket that it meets, and a task holds one at a time. Without
    buckets, or where a key or an order is nested, a fraction or collated, each key has its own entry: better for epochs that meet few of very many keys.
    The number stays as it is for the life of a checkpoint; one that was written before there were buckets goes on with 0.
    """
    schema = _kept(stream.schema)
    # Times go as numbers, which have no watermark of their own, so the operator sees late rows too.
    marked = stream.withWatermark(event_time, delay).select(
        *[(F.unix_micros(f.name) if _is_time(f) else F.col(f.name)).alias(f.name) for f in stream.schema.fields],
        F.unix_millis(event_time).alias("_at"))
    salt = F.pmod(F.xxhash64(*stream.columns), F.lit(salts))
    emitted_schema = T.StructType([*schema.fields, T.StructField(KIND, T.StringType())])
    marked = marked.withColumn("_salt", salt)
    if buckets and all(_is_plain(schema[c].dataType) for c in (*keys, *order)):
        bucket = F.pmod(F.xxhash64(*keys, "_salt"), F.lit(buckets)).cast("int").alias("_bucket")
        left = (
            marked.select("*", bucket).mapInArrow(_pack_batches, "_bucket int, rows binary").groupBy("_bucket")
            .transformWithState(_LatestOfMany([*keys, "_salt"], order, keep_seconds * 1000),
                                outputStructType=f"rows binary, {KIND} string", outputMode="Append", timeMode="EventTime")
            .mapInArrow(_unpack_batches(schema.names), emitted_schema)
        )
    else:
        left = marked.groupBy(*keys, "_salt").transformWithState(
            _Latest(schema, order, keep_seconds * 1000), outputStructType=emitted_schema, outputMode="Append", timeMode="EventTime")
    return left.select(*_given(stream.schema), KIND)


def _is_plain(kind: T.DataType) -> bool:
    # Collations equate texts that differ in bytes.
    return isinstance(kind, _PLAIN) and (not isinstance(kind, T.StringType) or kind == T.StringType())


def _is_time(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.TimestampType)


def _kept(schema: T.StructType) -> T.StructType:
    """The columns as the state holds them: times as microseconds, the same in the zone of every worker."""
    return T.StructType([T.StructField(f.name, T.LongType() if _is_time(f) else f.dataType) for f in schema.fields])


def _given(schema: T.StructType, prefix: str = "") -> list[Column]:
    """The columns of the stream from those that the state holds."""
    return [(F.timestamp_micros(prefix + f.name) if _is_time(f) else F.col(prefix + f.name)).alias(f.name) for f in schema.fields]


def start(left: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what leaves the state below ``out``, one folder per kind; the file sink makes each epoch count once."""
    conf = left.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        # The query keeps the settings of its start.
        return (
            left.writeStream.format("parquet").partitionBy(KIND).option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        conf.set(_PROVIDER, before)


def emitted(spark: SparkSession, out: str, schema: T.StructType, kind: str) -> DataFrame:
    """Rows of one kind that left the state so far."""
    declared = T.StructType([*schema.fields, T.StructField(KIND, T.StringType())])
    return spark.read.schema(declared).parquet(out).filter(F.col(KIND) == kind).drop(KIND)


def held(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """Rows in the state after the last epoch, read from the checkpoint without running the stream."""
    states = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    if states.schema["value"].dataType.names == ["rows"] and states.schema["key"].dataType.names == ["_bucket"]:
        kept = _kept(schema)
        return states.select("value.rows").mapInArrow(_unpack_batches(kept.names), kept).select(*_given(schema))
    return states.select(*_given(schema, "value."))


def current(spark: SparkSession, out: str, checkpoint: str, schema: T.StructType, keys: Sequence[str],
            order: Sequence[str]) -> DataFrame:
    """The newest row of each key over closed and held ones; ``schema`` is that of the stream."""
    rows = held(spark, checkpoint, schema).unionByName(emitted(spark, out, schema, CLOSED))
    values = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.struct(*order)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*rows.columns)
