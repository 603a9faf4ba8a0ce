"""Partition layout and write order on plain Parquet, and reads that prune by it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import PartitionField
from ..session import local_frame, materialize
from ..sources import files


@dataclass(frozen=True)
class SortField:
    """One entry of a write order. NULLs come first when ascending and last when descending."""

    by: PartitionField
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def nulls_lead(self) -> bool:
        return not self.descending if self.nulls_first is None else self.nulls_first

    def expression(self, schema: T.StructType) -> Column:
        value = self.by.value(schema)
        if self.descending:
            return value.desc_nulls_first() if self.nulls_lead else value.desc_nulls_last()
        return value.asc_nulls_first() if self.nulls_lead else value.asc_nulls_last()


def sort_by(column: str, descending: bool = False, nulls_first: bool | None = None) -> SortField:
    return SortField(PartitionField("identity", column), descending, nulls_first)


def with_partitions(df: DataFrame, spec: Sequence[PartitionField]) -> DataFrame:
    """Add one column per partition field. Unknown source columns raise."""
    columns = {f.column: f.value(df.schema) for f in spec}
    if len(columns) < len(spec) or set(columns) & set(df.columns):
        raise ValueError("partition field names clash")
    return df.withColumns(columns) if columns else df


def write_table(df: DataFrame, path: str, spec: Sequence[PartitionField] = (),
                order: Sequence[SortField] = (), distribution: str = "range",
                mode: str = "errorifexists", split_copies: bool = False) -> None:
    """Write under a partition spec and a write order.

    Without an order the rows are rebalanced by the partition columns: small partitions share
    a task, a partition with a large share of the rows is cut into several files. With an
    order, ``range`` gives files disjoint key ranges (the row hash splits long runs of equal
    keys), and ``hash`` rebalances and sorts each file. ``split_copies`` also spreads rows that
    are equal in every column, for the price of writing the rows once with a number each.
    """
    if distribution not in ("range", "hash"):
        raise ValueError(f"unknown distribution {distribution}")
    schema, columns, tie = df.schema, [f.column for f in spec], _row_hash(df.schema)
    if split_copies:
        # A number made while shuffling could differ when a task runs again; a stored one cannot.
        df, tie = materialize(df.withColumn("_copy", F.monotonically_increasing_id()), "copies"), F.col("_copy")
    placed = with_partitions(df, spec)
    if order:
        by = [F.col(c).asc() for c in columns] + [s.expression(schema) for s in order]
        placed = placed.repartitionByRange(*by, tie) if distribution == "range" else placed.hint("rebalance", *columns)
        placed = placed.sortWithinPartitions(*by)
    elif columns:
        placed = placed.hint("rebalance", *columns)
    writer = placed.drop("_copy").write.mode(mode)
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def _row_hash(schema: T.StructType) -> Column:
    """Hash of all columns Spark can hash, that is, all without a map inside."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in schema.fields if "map<" not in f.dataType.simpleString()])


def read_table(spark: SparkSession, path: str, schema: T.StructType,
               spec: Sequence[PartitionField] = ()) -> DataFrame:
    """Read a table with its partition columns, whose types are declared and not guessed."""
    added = with_partitions(local_frame(spark, schema), spec).schema.fields[len(schema):]
    return spark.read.schema(T.StructType(schema.fields + added)).parquet(path)


def between(df: DataFrame, schema: T.StructType, spec: Sequence[PartitionField], source: str,
            low: Column, high: Column, one_spec: bool = False) -> DataFrame:
    """Rows with ``low <= source <= high``, pruned to the partitions that can hold them.

    Every transform but the bucket keeps the order of its source, so the bounds carry over. A NULL
    partition column says nothing about a row: its file may be older than the field. With ``one_spec`` all
    files have been written under ``spec``.
    """
    result = df.filter(F.col(source).between(low, high))
    for f in spec:
        if f.source == source and f.transform != "bucket":
            kind = schema[source].dataType
            inside = F.col(f.column).between(f.value(schema, low.cast(kind)), f.value(schema, high.cast(kind)))
            result = result.filter(inside if one_spec else inside | F.col(f.column).isNull())
    return result


def equal_to(df: DataFrame, schema: T.StructType, spec: Sequence[PartitionField], source: str,
             value) -> DataFrame:
    """Rows whose source equals a literal, pruned by every transform of it, buckets included.

    As in :func:`between`, files older than a partition field are read as well.
    """
    kind = schema[source].dataType
    literal = F.lit(value).cast(kind)
    fields = [f for f in spec if f.source == source]
    result = df.filter(F.col(source) == literal)
    if fields:
        # One row on the driver: a bucket of a text is not a constant Catalyst can fold.
        known = df.sparkSession.range(1).select(*[f.value(schema, literal).alias(f.column) for f in fields]).first()
        for f in fields:
            column = F.col(f.column)
            result = result.filter((column == F.lit(known[f.column])) | column.isNull())
    return result


@dataclass(frozen=True)
class Layout:
    """The partition specs a table has had. Files keep the spec they were written under."""

    specs: tuple[tuple[PartitionField, ...], ...] = field(default=((),))

    @property
    def current(self) -> tuple[PartitionField, ...]:
        return self.specs[-1]

    @property
    def spec_id(self) -> int:
        return len(self.specs) - 1

    def add(self, new: PartitionField) -> Layout:
        if any(f.column == new.column or f.same_as(new) for f in self.current):
            raise ValueError(f"partition field {new.column} exists")
        return Layout((*self.specs, (*self.current, new)))

    def drop(self, old: PartitionField | str) -> Layout:
        """Drop by name, or by source and transform."""
        kept = tuple(
            f for f in self.current
            if (f.column != old if isinstance(old, str) else not f.same_as(old))
        )
        if len(kept) == len(self.current):
            raise ValueError("no such partition field in the current spec")
        return Layout((*self.specs, kept))

    def write(self, df: DataFrame, path: str, order: Sequence[SortField] = ()) -> None:
        """Append rows under the current spec."""
        write_table(df, f"{path}/spec={self.spec_id}", self.current, order, mode="append")

    def read(self, spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
        """All rows with the spec they are stored under; missing partition columns are NULL."""
        parts = [
            read_table(spark, f"{path}/spec={i}", schema, spec).withColumn("spec_id", F.lit(i))
            for i, spec in enumerate(self.specs) if files.exists(spark, f"{path}/spec={i}")
        ]
        empty = with_partitions(local_frame(spark, schema), self.current).withColumn("spec_id", F.lit(self.spec_id))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, empty)


    def matching(self, spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame) -> DataFrame:
        """Rows that equal some row of ``keys`` in all columns of it, read only from partitions that can hold them.

        ``keys`` is another table, with any of the columns of this one. Its rows go through the transforms of each spec, and
        the partitions that come out, no more than the table has, are joined to the files of that spec alone,
        so a runtime filter skips the folders of all others. NULL equals nothing; repeated keys count once.
        """
        wanted = keys.select(*[F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in keys.columns]).dropna().distinct()
        wanted = materialize(wanted, "keys")
        parts = []
        for i, spec in enumerate(self.specs):
            if not files.exists(spark, f"{path}/spec={i}"):
                continue
            part = read_table(spark, f"{path}/spec={i}", schema, spec)
            fields = [f for f in spec if f.source in keys.columns]
            if fields:
                columns = [f.column for f in fields]
                held = materialize(with_partitions(wanted, fields).groupBy(*columns).agg(F.count("*").alias("_n")), "partitions")
                # A runtime filter is only planned for a side that is filtered itself; every row passes.
                part = part.join(held.filter("_n > 0").drop("_n"), columns, "left_semi")
            parts.append(part.join(wanted, keys.columns, "left_semi").select(*schema.names, F.lit(i).alias("spec_id")))
        empty = local_frame(spark, schema).withColumn("spec_id", F.lit(self.spec_id))
        return reduce(DataFrame.unionByName, parts, empty)


def order_violations(spark: SparkSession, path: str, schema: T.StructType,
                     order: Sequence[SortField], spec: Sequence[PartitionField] = ()) -> DataFrame:
    """Per file: rows, and rows that stand before their predecessor in the write order."""
    rows = read_table(spark, path, schema, spec).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    in_file = Window.partitionBy("_file").orderBy("_at")
    wrong, equal = F.lit(False), F.col("_at") > 0
    for s in order:
        now = s.by.value(schema)
        before = F.lag(now).over(in_file)
        after = before < now if s.descending else before > now
        null_wrong = now.isNull() & before.isNotNull() if s.nulls_lead else now.isNotNull() & before.isNull()
        wrong = wrong | (equal & (F.coalesce(after, F.lit(False)) | null_wrong))
        equal = equal & now.eqNullSafe(before)
    return rows.withColumn("_wrong", wrong).groupBy("_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("_wrong").alias("n_wrong")
    )


def shard(df: DataFrame, n: int, column: str = "version") -> DataFrame:
    """Spread rows over ``n`` shards by the hash of a column, as a partition-ready number."""
    return df.withColumn("shard", F.pmod(F.xxhash64(column), F.lit(n)).cast("int"))
