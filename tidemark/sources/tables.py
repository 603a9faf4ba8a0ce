"""Tables that remember themselves: their schema, specs, order and properties are read from the stored log."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.datatypes import spark_type
from ..functions.transforms import PartitionField
from ..operators import metadata
from ..operators.layout import SortField, between, with_partitions, write_table
from ..operators.schema import FIELD_ID, TableSchema, conform, number_fields
from ..operators.skew import with_ordinal
from ..session import local_frame
from . import files
from .footers import drift_of_files, file_inventory


class Refused(ValueError):
    """Changes that the tables do not allow. Nothing was recorded."""


def change(table_name: str, version: str, kind: str, name: str | None = None, value: str | None = None, transform: str | None = None,
           param: int | None = None, descending: bool | None = None, nulls_first: bool | None = None) -> dict:
    """One change of one table; the columns of ``metadata.LOG`` but for ``seq``."""
    return dict(locals())


def changes_frame(spark: SparkSession, changes: Sequence[dict]) -> DataFrame:
    """Changes in the given order."""
    fields = T.StructType.fromDDL(metadata.LOG)
    rows = [{**c, "seq": i} for i, c in enumerate(changes)]
    return local_frame(spark, fields, {f.name: [r[f.name] for r in rows] for f in fields.fields})


class TableStore:
    """A folder with the log of all tables and their data. One writer at a time; readers need no care.

    Nothing is kept in memory between calls: another object on the same folder, in another session, sees the same tables.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        folder = f"{self.path}/log"
        fields = T.StructType.fromDDL(metadata.LOG)
        return self.spark.read.schema(fields).parquet(folder) if files.exists(self.spark, folder) else local_frame(self.spark, fields)

    def states(self, asked: DataFrame | None = None) -> DataFrame:
        """The tables' newest states, or those as of the versions asked for (table_name, as_of)."""
        return metadata.states(self.log(), asked)

    def record(self, changes: DataFrame) -> None:
        """Add changes (``metadata.LOG``; their order per version is that of ``seq``) behind what is stored.

        All or none: if a table's state refuses any of them, Refused lists the first ones and nothing is stored.
        """
        last = self.log().agg(F.max("seq")).first()[0]
        start = 0 if last is None else last + 1
        numbered = with_ordinal(metadata.tidy_log(changes), [F.col("version"), F.col("seq"), F.col("table_name")], name="at")
        new = numbered.withColumn("seq", F.lit(start) + F.col("at") - 1).drop("at")
        touched = new.select("table_name").distinct()
        refused = metadata.refusals(self.log().join(touched, "table_name", "left_semi").unionByName(new))
        wrong = refused.filter(F.col("seq") >= start).orderBy("seq").limit(5).collect()
        if wrong:
            raise Refused("; ".join(f"{r.table_name} at {r.version}: {r.reason}" for r in wrong))
        new.write.mode("append").parquet(f"{self.path}/log")

    def exists(self, name: str) -> bool:
        return not metadata.counted_states(self.log()).filter((F.col("table_name") == name) & F.col("is_there")).isEmpty()

    def create(self, name: str, version: str, columns: Mapping[str, str], comments: Mapping[str, str] | None = None,
               partitions: Sequence[PartitionField] = (), order: Sequence[SortField] = (),
               properties: Mapping[str, str] | None = None) -> None:
        """Record a new table; Refused if it exists."""
        rows = [change(name, version, "create")]
        rows += [change(name, version, "add", c, t) for c, t in columns.items()]
        rows += [change(name, version, "comment", c, t) for c, t in (comments or {}).items()]
        rows += [change(name, version, "add_partition", f.source, f.name, f.transform, f.param) for f in partitions]
        rows += [change(name, version, "order_by", s.by.source, None, s.by.transform, s.by.param, s.descending, s.nulls_first) for s in order]
        rows += [change(name, version, "set", k, v) for k, v in (properties or {}).items()]
        for c in columns.values():
            spark_type(c)
        self.record(changes_frame(self.spark, rows))

    def create_if_absent(self, name: str, version: str, columns: Mapping[str, str], **more) -> bool:
        """Create the table unless it exists; then nothing changes, whatever its columns are. True if it was created."""
        if self.exists(name):
            return False
        self.create(name, version, columns, **more)
        return True

    def step_down(self, version: str, changes: DataFrame, forget) -> None:
        """Take a version back by the given changes, then ``forget()`` it in the ledger.

        If a change is refused, as a narrowing one is, the version stays applied: neither log nor ledger changes.
        """
        self.record(changes.withColumn("version", F.lit(version)))
        forget()

    def open(self, name: str, as_of: str | None = None) -> StoredTable:
        """The table as it is now, or its state as of a version."""
        log = self.log().filter(F.col("table_name") == name)
        asked = None if as_of is None else local_frame(self.spark, "table_name string, as_of string", {"table_name": [name], "as_of": [as_of]})
        state = metadata.counted_states(log, asked).first()
        if state is None or not state.is_there:
            raise ValueError(f"no table {name}")
        fills = [r.name for r in log.filter("kind = 'fill'").select("name").distinct().orderBy("name").collect()]
        retired = log.filter("kind = 'retire'").select(F.col("name").alias("file"))
        return StoredTable(self.spark, f"{self.path}/data/{name}", state, tuple(fills), retired)

    def backfill(self, name: str, version: str, most_bytes: int = 1 << 40) -> tuple[int, int]:
        """Rewrite files of older columns or specs under the current ones; returns how many were rewritten and how many are left.

        Footers tell which files differ. Files up to ``most_bytes`` together (one at least) are read and written to a folder of this run;
        one write to the log then puts it in the place of the old files. Until then the run does not count, so one that is
        interrupted leaves the table as it was, and the next call goes on with what is left. Files that need no
        change are neither read nor written, and old ones stay where they are for readers that have opened them.
        """
        stored = self.open(name)
        held = file_inventory(self.spark, stored.path).withColumn("file", stored.relative("file"))
        current = F.concat(F.lit("spec="), F.lit(len(stored.specs) - 1), F.lit("/"))
        # Folders of runs that did not come to their end hold no data of the table.
        live = F.col("file").startswith("spec=") | F.split_part("file", F.lit("/"), F.lit(1)).isin([f"fill={f}" for f in stored.fills])
        held = held.filter(live).join(stored.retired, "file", "left_anti")
        sizes = held.groupBy("file").agg(F.first("n_bytes").alias("n_bytes"))
        changed = drift_of_files(held, stored.schema).select("file").distinct()
        misplaced = sizes.filter(~F.contains("file", current)).select("file")
        todo = sizes.join(changed.union(misplaced).distinct(), "file", "left_semi")
        order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        # One row per file, as Spark's own file listing.
        listed = todo.select("file", F.coalesce(F.sum("n_bytes").over(order), F.lit(0)).alias("before"), "n_bytes").orderBy("file").collect()
        taken = [r.file for r in listed if r.before == 0 or r.before + r.n_bytes <= most_bytes]
        if taken:
            fill = uuid.uuid4().hex
            stored.rewrite(taken, fill)
            self.record(changes_frame(self.spark, [change(name, version, "fill", fill)] + [change(name, version, "retire", f) for f in taken]))
        return len(taken), len(listed) - len(taken)


@dataclass(frozen=True)
class StoredTable:
    """One table by one state of it."""

    spark: SparkSession
    path: str
    state: Row
    fills: tuple[str, ...] = ()
    retired: DataFrame | None = None

    @property
    def schema(self) -> TableSchema:
        fields = []
        for c in self.state.columns:
            kind = spark_type(c.type)
            inner, _ = number_fields(kind, c.field_id - metadata.fields_inside(c.type))
            comment = {"comment": c.comment} if c.comment else {}
            fields.append(T.StructField(c.name, inner, True, {**comment, FIELD_ID: c.field_id}))
        return TableSchema(T.StructType(fields), self.state.last_id)

    def _names(self) -> dict[int, str]:
        return {c.field_id: c.name for c in self.state.columns}

    @property
    def specs(self) -> list[list[PartitionField]]:
        """All specs in order; fields of columns that are gone are left out."""
        names = self._names()
        return [[PartitionField(f.transform, names[f.source_id], f.param, f.name) for f in spec if f.source_id in names]
                for spec in self.state.specs]

    @property
    def order(self) -> list[SortField]:
        names = self._names()
        return [SortField(PartitionField(s.transform, names[s.source_id], s.param), s.descending, s.nulls_first) for s in self.state.write_order]

    @property
    def properties(self) -> dict[str, str]:
        return dict(self.state.properties)

    def _folder(self, spec_id: int) -> str:
        return f"{self.path}/spec={spec_id}"

    def append(self, rows: DataFrame) -> None:
        """Add rows under the current spec and order; columns are matched by name and cast, missing ones are null."""
        specs = self.specs
        write_table(conform(rows, self.schema), self._folder(len(specs) - 1), specs[-1], self.order, mode="append")

    def relative(self, file: str) -> Column:
        """A file's path below the table's folder."""
        return F.split_part(F.col(file), F.lit(f"{self.path.split('://')[-1].rstrip('/')}/"), F.lit(-1))

    def _folders(self, spec_id: int) -> list[str]:
        """Where rows of a spec lie: its own folder and those of the backfills that count."""
        return [p for p in [self._folder(spec_id), *[f"{self.path}/fill={f}/spec={spec_id}" for f in self.fills]] if files.exists(self.spark, p)]

    def _parts(self) -> list[tuple[int, list[PartitionField], DataFrame]]:
        """The rows stored under each spec that has any, with its partition columns; retired files are left out."""
        fields, found = self.schema.columns, []
        for i, spec in enumerate(self.specs):
            for folder in self._folders(i):
                added = with_partitions(local_frame(self.spark, fields), spec).schema.fields[len(fields):]
                rows = self.spark.read.schema(T.StructType(fields.fields + added)).parquet(folder)
                if self.fills:
                    rows = rows.withColumn("_path", F.col("_metadata.file_path")).withColumn("_path", self.relative("_path")).join(
                        self.retired, F.col("_path") == F.col("file"), "left_anti").drop("_path")
                found.append((i, spec, rows))
        return found

    def rewrite(self, taken: Sequence[str], fill: str) -> None:
        """Write the rows of the files again, under the current columns, spec and order, into the folder of a backfill."""
        specs = self.specs
        rows = self.spark.read.schema(self.schema.columns).parquet(*[f"{self.path}/{f}" for f in taken]).select(self.schema.names)
        write_table(conform(rows, self.schema), f"{self.path}/fill={fill}/spec={len(specs) - 1}", specs[-1], self.order)

    def _together(self, parts: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts, local_frame(self.spark, self.schema.columns))

    def read(self) -> DataFrame:
        """All rows under this state's columns, found by field id in files of every age."""
        return self._together([df.select(self.schema.names) for _, _, df in self._parts()])

    def read_between(self, source: str, low: Column, high: Column) -> DataFrame:
        """Rows with ``low <= source <= high``; each spec's files are pruned by that spec's own fields before they are united."""
        return self._together([between(df, self.schema.columns, spec, source, low, high, one_spec=True).select(self.schema.names)
                               for _, spec, df in self._parts()])
