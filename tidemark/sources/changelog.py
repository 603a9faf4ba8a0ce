"""Versioned change sets on tables: up, down, to, redo, release and rollback.

A version holds the changes of one or more tables. Its rows are staged when it is added, and
it is applied or reverted by one entry in the commit list, so no table is rewritten for it.
Readers merge the changes of the applied versions into the base tables; folding writes that
merge down, so that later reads merge less.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_target, parse_version, version_key
from ..operators import ledger_state as state
from ..operators.changes import apply_changes, change_schema
from ..plans import steps
from ..session import local_frame
from . import files
from .batches import BatchStore, Refused

_MARK = "_versions"


@dataclass(frozen=True)
class TrackedTable:
    base: DataFrame
    keys: Sequence[str]


class ChangeLog:
    def __init__(self, store: BatchStore, tables: Mapping[str, TrackedTable], scope: str = ""):
        self.store, self.tables, self.scope = store, dict(tables), scope
        self.spark = store.spark

    # -- versions

    def add(self, version: str, changes: Mapping[str, DataFrame]) -> None:
        """Stage a version. It can be applied once all its tables are staged."""
        seen = self.spark.range(1).select(parse_version(F.lit(version)).alias("v")).first().v
        if not seen.valid or version == state.BASE_VERSION:
            raise Refused(f"{version}: {seen.reason or 'reserved'}")
        if not self._folds().filter(F.col("version") == version).isEmpty():
            raise Refused(f"{version} is part of a fold; give the changed version a new name")
        for name, rows in changes.items():
            self.store.stage(name, rows.drop("batch_id"), version)
        self.store.stage(_MARK, self.spark.range(1), version)

    def defined(self) -> DataFrame:
        folder = f"{self.store.path}/tables/{_MARK}"
        found = [
            n.split("=", 1)[1] for n in files.names(self.spark, folder)
            if n.startswith("batch_id=") and files.exists(self.spark, f"{folder}/{n}/_SUCCESS")
        ]
        return local_frame(self.spark, "version string", {"version": found}).select(
            F.lit(self.scope).alias("scope"), "version")

    def applied(self) -> DataFrame:
        return self.store.committed().select(
            F.lit(self.scope).alias("scope"), F.col("batch_id").alias("version"), "apply_time"
        )

    def pending(self) -> DataFrame:
        return state.pending(self.defined(), self.applied())

    def history(self, n: int | None = state.DEFAULT_HISTORY) -> DataFrame:
        return state.history(self.applied(), n)

    # -- reading

    def rows(self, table: str) -> DataFrame:
        """The table with the changes of every applied version, in version order."""
        return self._rows(table, self.applied().select("version"))

    def _rows(self, table: str, live: DataFrame) -> DataFrame:
        tracked = self.tables[table]
        fold, folded = self._fitting_fold(live)
        base = tracked.base
        if fold is not None:
            base = self.spark.read.schema(base.schema).parquet(f"{self.store.path}/folds/{fold}/{table}")
        schema = change_schema(tracked.base.schema, tracked.keys)
        unfolded = live.join(folded, "version", "left_anti").select(F.col("version").alias("batch_id"))
        changes = self.store.staged(table, schema).join(unfolded, "batch_id", "left_semi").drop("batch_id")
        return apply_changes(base, changes, tracked.keys)

    def _folds(self) -> DataFrame:
        """(fold, version) of every complete fold. Older folds hold their versions in the marker, newer ones beside the tables."""
        folder = f"{self.store.path}/folds"
        done = [n for n in files.names(self.spark, folder) if n.endswith(".json")]
        if not done:
            return local_frame(self.spark, "fold int, version string")
        marks = self.spark.read.schema("fold int, versions array<string>, complete boolean").json(
            [f"{folder}/{n}" for n in done]).filter("complete")
        found = marks.select("fold", F.explode("versions").alias("version"))
        for row in marks.filter("versions IS NULL").select("fold").collect():
            listed = self.spark.read.schema("version string").parquet(f"{folder}/{row.fold}/{_MARK}")
            found = found.union(listed.select(F.lit(row.fold).alias("fold"), "version"))
        return found

    def _fitting_fold(self, live: DataFrame) -> tuple[int | None, DataFrame]:
        """The newest fold that holds exactly the ``live`` versions up to its last one, and its versions."""
        folds, live = self._folds().distinct(), live.select("version").distinct()
        ends = folds.groupBy("fold").agg(F.count("*").alias("n"), F.max("version").alias("last"))
        held = folds.join(live, "version", "left_semi").groupBy("fold").agg(F.count("*").alias("held"))
        # One row per fold.
        upto = live.join(F.broadcast(ends), F.col("version") <= F.col("last")).groupBy("fold").agg(F.count("*").alias("upto"))
        fits = ends.join(held, "fold").join(upto, "fold").filter("n = held AND n = upto")
        fold = fits.agg(F.max("fold")).first()[0]
        return fold, folds.filter(F.col("fold") == F.lit(fold)).select("version")

    def _best_fold(self, live: set[str]) -> tuple[int | None, set[str]]:
        """``_fitting_fold`` for a set of versions."""
        fold, versions = self._fitting_fold(local_frame(self.spark, "version string", {"version": sorted(live)}))
        return fold, {r.version for r in versions.collect()}

    def fold(self, upto: str | None = None) -> int | None:
        """Write all tables with the applied versions up to one, by default all but the newest batch.

        Older folds and the change rows stay, so a version can still be reverted afterwards:
        reads then start from the newest fold without it.
        """
        live = self.applied()
        last = upto
        if last is None:
            newest = F.broadcast(live.agg(F.max("apply_time").alias("top")))
            last = live.join(newest, F.col("apply_time") < F.col("top")).agg(F.max("version")).first()[0]
        wanted = live.filter(F.substring("version", 1, 13) <= F.lit((last or "")[:13])).select("version")
        if wanted.isEmpty():
            return None
        folder = f"{self.store.path}/folds"
        fold = max((int(n.split(".")[0]) for n in files.names(self.spark, folder)), default=0) + 1
        # Written first, so that all tables hold the same versions.
        wanted.write.parquet(f"{folder}/{fold}/{_MARK}")
        wanted = self.spark.read.schema("version string").parquet(f"{folder}/{fold}/{_MARK}")
        for table in self.tables:
            self._rows(table, wanted).write.parquet(f"{folder}/{fold}/{table}")
        text = json.dumps({"fold": fold, "complete": True}) + "\n"
        return fold if files.create_once(self.spark, f"{folder}/{fold}.json", text) else None

    # -- commands

    def _versions(self, plan: DataFrame) -> list[str]:
        """The versions of one command, which become one commit."""
        return [r.version for r in plan.select("version").collect()]

    @staticmethod
    def _check(n: int | None) -> None:
        if n is not None and n < 1:
            raise ValueError("n must be at least 1")

    def _apply(self, versions: Sequence[str], apply_time: int | None, after: int) -> list[str]:
        """One commit; the apply times still count up, so each version is a batch of its own."""
        return self.store.commit(versions, int(time.time()) if apply_time is None else apply_time, step=1, after=after)

    def _revert(self, versions: Sequence[str], after: int) -> list[str]:
        if versions:
            self.store.withdraw(versions, after)
        return list(versions)

    def up(self, n: int | None = None, apply_time: int | None = None) -> list[str]:
        """Apply the first ``n`` pending versions in one commit, oldest first; ``None`` means all."""
        self._check(n)
        after, todo = self.store.last(), self.pending()
        return self._apply(self._versions(todo if n is None else todo.limit(n)), apply_time, after)

    def down(self, n: int | None = 1) -> list[str]:
        """Revert the newest ``n`` applied versions in one commit, newest first."""
        self._check(n)
        after = self.store.last()
        return self._revert(self._versions(self.history(n)), after)

    def redo(self, n: int | None = 1, apply_time: int | None = None) -> list[str]:
        """Revert the newest ``n`` versions and apply them again, oldest first, in one commit."""
        self._check(n)
        after = self.store.last()
        again = self._versions(self.history(n))[::-1]
        return self.store.renew(again, int(time.time()) if apply_time is None else apply_time, step=1, after=after)

    def to(self, target: str, apply_time: int | None = None) -> list[str]:
        """Go to a target: back to it when it is applied, otherwise forward up to it."""
        after = self.store.last()
        stamp = self.spark.range(1).select(normalize_target(F.lit(target), strict=True)).first()[0]
        plan = steps.plan_to(self.defined(), self.applied(), stamp, numbered=False)
        if self.applied().filter(version_key("version") == stamp).isEmpty():
            return self._apply(self._versions(plan), apply_time, after)
        return self._revert(self._versions(plan), after)

    def apply(self, version: str, apply_time: int | None = None) -> None:
        """Apply one version; raises when it is not defined or applied already."""
        if self.defined().filter(F.col("version") == version).isEmpty():
            raise Refused(f"{version} is not defined")
        self.store.commit([version], int(time.time()) if apply_time is None else apply_time)

    def revert(self, version: str) -> None:
        """Revert one version; raises when it is not applied."""
        self.store.withdraw([version])

    def release(self, apply_time: int | None = None) -> list[str]:
        """Apply everything pending as one batch with one apply time, all or nothing."""
        after = self.store.last()
        todo = self._versions(self.pending())
        return self.store.commit(todo, int(time.time()) if apply_time is None else apply_time, after=after) if todo else []

    def rollback(self) -> list[str]:
        """Revert the newest batch as one step."""
        after = self.store.last()
        newest = sorted(self.store.newest(), reverse=True)
        if newest:
            self.store.withdraw(newest, after)
        return newest
