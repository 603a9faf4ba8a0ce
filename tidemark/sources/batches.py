"""Batches: rows of several tables and their ledger rows become visible at once, or not at all."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger_state import KEY, duplicate_keys, missing_counterparts
from ..session import local_frame
from . import files
from .ledger import ROWS, ledger_rows

LEDGER = "_ledger"
COMMITS = "n bigint, batch_id string, apply_time bigint, live boolean"
COMMIT_FILE = "n bigint, entries array<struct<batch_id: string, apply_time: bigint, live: boolean>>, complete boolean"

# Up to this many batch ids become a literal filter on the partition column.
LITERAL_IDS = 1000


class AlreadyApplied(ValueError):
    """The batch to apply is applied."""


class NotApplied(ValueError):
    """The batch to revert is not applied."""


class Refused(ValueError):
    """A check before the commit failed; nothing became visible."""


class BatchStore:
    """Tables below one folder, published in batches.

    Rows are staged under ``tables/<table>/batch_id=<id>``. Creating the next file below
    ``commits`` is the only commit point: readers take the committed ids first and filter the
    partition column by them. Staged rows without a commit are never read.

    Whoever publishes notes the last commit before its checks and creates the one that follows it.
    When another writer was first, the checks are out of date: :class:`Refused`, and the caller
    starts over.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # -- commits

    def last(self) -> int:
        """Number of the newest commit, 0 if there is none."""
        found = files.names(self.spark, f"{self.path}/commits")
        return max((int(n.split(".")[0]) for n in found if n.endswith(".json")), default=0)

    def _commit(self, rows: Sequence[Mapping], after: int) -> None:
        # One line whose last field says that it was written to the end.
        text = json.dumps({"n": after + 1, "entries": list(rows), "complete": True}) + "\n"
        if not files.create_once(self.spark, f"{self.path}/commits/{after + 1:08d}.json", text):
            raise Refused("another writer published meanwhile; start over")

    def commits(self) -> DataFrame:
        folder = f"{self.path}/commits"
        if not files.names(self.spark, folder):
            return local_frame(self.spark, COMMITS)
        return self.spark.read.schema(COMMIT_FILE).json(folder).filter("complete").select("n", F.inline("entries"))

    def committed(self) -> DataFrame:
        """Batches that are live now, with their apply time."""
        return (
            self.commits().groupBy("batch_id")
            .agg(F.max_by(F.struct("apply_time", "live"), "n").alias("last"))
            .select("batch_id", "last.*").filter("live").drop("live")
        )

    def _live(self, batch_ids: Sequence[str]) -> dict[str, int]:
        """Those of the given batches that are live, with their apply time."""
        found = self.committed().join(self._frame(batch_ids), "batch_id", "left_semi")
        return {r.batch_id: r.apply_time for r in found.collect()}

    def is_committed(self, batch_id: str) -> bool:
        return not self.committed().filter(F.col("batch_id") == batch_id).isEmpty()

    def commit(self, batch_ids: Iterable[str], apply_time: int, strict: bool = True, step: int = 0,
               after: int | None = None) -> list[str]:
        """Make staged batches visible together, each ``step`` later. Applied ones raise, or are skipped if not strict.

        ``after`` is the :meth:`last` commit that the caller's own checks have seen.
        """
        wanted = list(batch_ids)
        after = self.last() if after is None else after
        known = self._live(wanted)
        if known and strict:
            raise AlreadyApplied(", ".join(sorted(known)))
        new = [b for b in wanted if b not in known]
        if new:
            self._commit([{"batch_id": b, "apply_time": apply_time + i * step, "live": True} for i, b in enumerate(new)],
                         after)
        return new

    def renew(self, batch_ids: Iterable[str], apply_time: int, step: int = 0, after: int | None = None) -> list[str]:
        """Give live batches new apply times together, as if they were taken back and made visible again."""
        wanted = list(batch_ids)
        after = self.last() if after is None else after
        gone = set(wanted) - set(self._live(wanted))
        if gone:
            raise NotApplied(", ".join(sorted(gone)))
        if wanted:
            self._commit([{"batch_id": b, "apply_time": apply_time + i * step, "live": True} for i, b in enumerate(wanted)],
                         after)
        return wanted

    def withdraw(self, batch_ids: Iterable[str], after: int | None = None) -> None:
        """Take live batches back, newest commit wins; their files stay where they are."""
        wanted = list(batch_ids)
        after = self.last() if after is None else after
        live = self._live(wanted)
        if set(wanted) - set(live):
            raise NotApplied(", ".join(sorted(set(wanted) - set(live))))
        self._commit([{"batch_id": b, "apply_time": live[b], "live": False} for b in wanted], after)

    # -- tables

    def stage(self, table: str, rows: DataFrame, batch_id: str) -> None:
        """Write the rows of a batch. Staging again replaces them, unless readers see them."""
        if self.is_committed(batch_id):
            raise AlreadyApplied(batch_id)
        rows.write.mode("overwrite").parquet(f"{self.path}/tables/{table}/batch_id={batch_id}")

    def stage_many(self, table: str, rows: DataFrame) -> None:
        """Stage rows that carry their ``batch_id``, many batches in one job."""
        rows.hint("rebalance", "batch_id").write.mode("append").partitionBy("batch_id").parquet(
            f"{self.path}/tables/{table}"
        )

    def staged(self, table: str, schema: T.StructType | str) -> DataFrame:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not files.exists(self.spark, f"{self.path}/tables/{table}"):
            return local_frame(self.spark, schema).withColumn("batch_id", F.lit(None).cast("string"))
        declared = T.StructType([f for f in schema.fields if f.name != "batch_id"]).add("batch_id", "string")
        return self.spark.read.schema(declared).parquet(f"{self.path}/tables/{table}")

    def read(self, table: str, schema: T.StructType | str) -> DataFrame:
        """Rows of live batches."""
        ids = [r.batch_id for r in self.committed().select("batch_id").limit(LITERAL_IDS + 1).collect()]
        if len(ids) <= LITERAL_IDS:
            return self.of_batches(table, schema, ids)
        return self.staged(table, schema).join(self.committed().select("batch_id"), "batch_id", "left_semi")

    def of_batches(self, table: str, schema: T.StructType | str, batch_ids: Sequence[str]) -> DataFrame:
        """Rows of the given batches. Few ids prune the folders; very many are joined instead."""
        rows = self.staged(table, schema)
        if len(batch_ids) <= LITERAL_IDS:
            return rows.filter(F.col("batch_id").isin(list(batch_ids)))
        return rows.join(self._frame(batch_ids), "batch_id", "left_semi")

    def _frame(self, batch_ids: Sequence[str]) -> DataFrame:
        return local_frame(self.spark, "batch_id string", {"batch_id": list(batch_ids)})

    def applied(self) -> DataFrame:
        return self.read(LEDGER, ROWS)

    # -- batches of versions

    def check_unique(self, table: str, schema: T.StructType, keys: Sequence[str], batch_id: str) -> None:
        """Refuse a batch with repeated keys. Published keys are unique, so only new ones are checked."""
        new = self.staged(table, schema).filter(F.col("batch_id") == batch_id)
        if not duplicate_keys(new, keys).isEmpty():
            raise Refused(f"{table}: a key occurs twice in batch {batch_id}")
        if not self.read(table, schema).join(new.select(*keys), list(keys), "left_semi").isEmpty():
            raise Refused(f"{table}: a key of batch {batch_id} is published already")

    def release(self, versions: DataFrame, tables: Mapping[str, DataFrame],
                keys: Mapping[str, Sequence[str]] | None = None, apply_time: int | None = None,
                batch_id: str | None = None) -> str:
        """Apply all versions and their rows as one batch with one apply time, or nothing."""
        at = int(time.time()) if apply_time is None else apply_time
        batch_id = batch_id or f"b{at}-{uuid.uuid4().hex[:8]}"
        new, after = versions.select(*KEY), self.last()
        if not self.applied().join(new, list(KEY), "left_semi").isEmpty():
            raise AlreadyApplied("a version of the batch is applied")
        for table, rows in tables.items():
            self.stage(table, rows, batch_id)
        self.stage(LEDGER, ledger_rows(new, F.lit(at)).drop("batch_id"), batch_id)
        for table, columns in (keys or {}).items():
            self.check_unique(table, tables[table].schema, columns, batch_id)
        self.commit([batch_id], at, after=after)
        return batch_id

    def newest(self) -> list[str]:
        """Live batches that share the greatest apply time."""
        live = self.committed()
        top = live.agg(F.max("apply_time").alias("_top"))
        return [r.batch_id for r in live.crossJoin(F.broadcast(top)).filter("apply_time = _top").collect()]

    def rollback(self, counterparts: DataFrame | None = None) -> list[str]:
        """Take back the newest batch. Refused when a version of it has no way down."""
        after = self.last()
        newest = self.newest()
        if not newest:
            return []
        if counterparts is not None:
            versions = self.applied().filter(F.col("batch_id").isin(newest))
            if not missing_counterparts(versions, counterparts, KEY).isEmpty():
                raise Refused("a version has no counterpart to revert it")
        self.withdraw(newest, after)
        return newest

    def apply_each(self, batch_ids: Sequence[str], table: str, schema: T.StructType,
                   keys: Sequence[str], first_time: int) -> tuple[list[str], str | None]:
        """Best effort: commit staged batches one by one and stop at the first refusal."""
        done: list[str] = []
        for i, batch_id in enumerate(batch_ids):
            try:
                after = self.last()
                self.check_unique(table, schema, keys, batch_id)
                self.commit([batch_id], first_time + i, after=after)
            except ValueError as error:
                return done, str(error)
            done.append(batch_id)
        return done, None
