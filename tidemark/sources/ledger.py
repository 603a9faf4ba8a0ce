"""The ledger: an append-only Parquet log of applied versions, partitioned by month."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger_state import BASE_VERSION, KEY, applied, guard_reserved, join_keys, latest
from ..session import local_frame
from . import files

ROWS = "scope string, version string, apply_time bigint, seq bigint, is_deleted int, batch_id string"
COLUMNS = ("scope", "version", "apply_time", "seq", "is_deleted", "batch_id")
STORED = f"{ROWS}, apply_date date, yyyymm string"

# Fixed value: prefix of the property keys that hold applied versions.
PROPERTY_PREFIX = "migrate."


def stored_columns(rows: DataFrame) -> DataFrame:
    """Rows with the columns computed on insert: the apply date and its month."""
    moment = F.timestamp_seconds("apply_time")
    return rows.withColumns({"apply_date": F.to_date(moment), "yyyymm": F.date_format(moment, "yyyyMM")})


def ledger_rows(keys: DataFrame, apply_time: Column, deleted: bool = False, batch_id: str | None = None) -> DataFrame:
    """Ledger rows for a set of keys that share one apply time."""
    return keys.select(
        *KEY,
        apply_time.cast("bigint").alias("apply_time"),
        F.lit(time.time_ns() // 1000).alias("seq"),
        F.lit(int(deleted)).alias("is_deleted"),
        F.lit(batch_id).cast("string").alias("batch_id"),
    )


def from_properties(bags: DataFrame, properties: str = "properties") -> DataFrame:
    """Applied versions kept as ``migrate.<version>`` properties, one bag per row.

    Other keys are ignored; a value that is no integer fails the job.
    """
    others = [c for c in bags.columns if c != properties]
    return (
        bags.select(*others, F.explode(properties).alias("key", "value"))
        .filter(F.col("key").startswith(PROPERTY_PREFIX))
        .select(
            *others,
            F.substring("key", len(PROPERTY_PREFIX) + 1, 2**31 - 1).alias("version"),
            F.when(F.rlike("value", F.lit(r"^[+-]?\d+\z")), F.col("value").cast("bigint"))
            .otherwise(F.raise_error(F.concat(F.lit("no integer: "), F.coalesce("value", F.lit("NULL")))).cast("bigint"))
            .alias("apply_time"),
        )
    )


def to_properties(rows: DataFrame) -> DataFrame:
    """One property bag per ledger row; bags merge by union, so no scope is gathered in one row."""
    return rows.select(
        "scope",
        F.create_map(F.concat(F.lit(PROPERTY_PREFIX), "version"), F.col("apply_time").cast("string")).alias("properties"),
    )


class Ledger:
    """A stored ledger. One writer at a time compacts; appends and reads may run beside others.

    The log is the newest of the numbered generations and all appends that it has not merged. Each append has a
    folder of its own, so one that ends while a compaction runs is not in that compaction's list and
    stays part of the log. A folder counts once Spark has put its success marker there, so a
    failed write leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _generations(self) -> list[int]:
        found = [n for n in files.names(self.spark, self.path) if n.startswith("g=")]
        return [int(n[2:]) for n in found if files.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]

    def _folder(self, generation: int) -> str:
        return f"{self.path}/g={generation:06d}"

    def exists(self) -> bool:
        return bool(self._generations())

    def initialize(self, apply_time: int | None = None) -> bool:
        """Create the ledger with its base row. False when it is there already."""
        if self.exists():
            return False
        base = self.spark.range(1).select(F.lit("").alias("scope"), F.lit(BASE_VERSION).alias("version"))
        at = int(time.time()) if apply_time is None else apply_time
        self._write(ledger_rows(base, F.lit(at)), self._folder(0), "overwrite")
        return True

    def _write(self, rows: DataFrame, folder: str, mode: str) -> None:
        # A month with most of the rows is cut into several files; small months share a task.
        placed = stored_columns(rows.select(*COLUMNS)).hint("rebalance", "yyyymm")
        placed.write.mode(mode).partitionBy("yyyymm").parquet(folder)

    def append(self, rows: DataFrame) -> None:
        """Append ledger rows as they are; the base row is refused."""
        if not self.exists():
            raise ValueError("the ledger is not initialised")
        self._write(guard_reserved(rows), f"{self.path}/appends/append={uuid.uuid4().hex}", "errorifexists")

    def _appends(self) -> list[str]:
        folder = f"{self.path}/appends"
        return [n.partition("=")[2] for n in files.names(self.spark, folder) if files.exists(self.spark, f"{folder}/{n}/_SUCCESS")]

    def _merged(self, generation: int) -> str:
        return f"{self.path}/merged/g={generation:06d}"

    def _state(self) -> tuple[int, list[str], list[str]]:
        """The newest generation, the appends it has merged, and those that come on top."""
        current = self._generations()
        if not current:
            raise ValueError("the ledger is not initialised")
        merged = []
        if current[-1]:
            merged = [r.append for r in self.spark.read.schema("append string").parquet(self._merged(current[-1])).collect()]
        return current[-1], merged, sorted(set(self._appends()) - set(merged))

    def record(self, keys: DataFrame, apply_time: int | None = None, batch_id: str | None = None) -> None:
        """Mark versions as applied, now or at a given shared time."""
        at = F.unix_timestamp() if apply_time is None else F.lit(apply_time)
        self.append(ledger_rows(keys, at, batch_id=batch_id))

    def remove(self, keys: DataFrame, apply_time: int | None = None) -> None:
        """Mark versions as not applied, by tombstones that win over any earlier row."""
        at = F.unix_timestamp() if apply_time is None else F.lit(apply_time)
        self.append(ledger_rows(keys, at, deleted=True))

    def log(self, months: Sequence[str] | None = None) -> DataFrame:
        """All stored rows. An empty ledger reads as no rows, as a dry run needs it."""
        if not self.exists():
            return local_frame(self.spark, STORED)
        generation, _, added = self._state()
        rows = self._rows(generation, added)
        return rows if months is None else rows.filter(F.col("yyyymm").isin(list(months)))

    def _rows(self, generation: int, added: Sequence[str]) -> DataFrame:
        rows = self.spark.read.schema(STORED).parquet(self._folder(generation))
        if not added:
            return rows
        appends = self.spark.read.schema(f"{STORED}, append string").parquet(f"{self.path}/appends")
        return rows.unionByName(appends.filter(F.col("append").isin(list(added))).drop("append"))

    def applied(self) -> DataFrame:
        return applied(self.log())

    def compact(self) -> None:
        """Rewrite the log to the newest row of each key, as a new generation.

        Tombstones stay, so a row that arrives late does not come back to life. The old
        generation is left in place for readers that started on it.
        """
        self._next(latest)

    def purge(self, keys: DataFrame) -> None:
        """Physically remove all rows of the keys, as a new generation. A NULL scope is a scope."""
        gone = guard_reserved(keys.select(*KEY)).distinct()
        self._next(lambda rows: join_keys(rows, gone, KEY, "left_anti"))

    def _next(self, change: Callable[[DataFrame], DataFrame]) -> None:
        generation, merged, added = self._state()
        # The list counts only together with its generation, whose success marker comes last.
        local_frame(self.spark, "append string", {"append": merged + added}).coalesce(1).write.mode("overwrite").parquet(
            self._merged(generation + 1))
        self._write(change(self._rows(generation, added)), self._folder(generation + 1), "overwrite")
