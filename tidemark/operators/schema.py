"""Evolving tables: identity follows the field id, never the name or the position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.datatypes import WRITTEN_TYPE, is_widening, spark_type

FIELD_ID = "parquet.field.id"


@dataclass(frozen=True)
class TableSchema:
    """Columns with field ids, and the highest id ever given out, so that none is used twice."""

    columns: T.StructType
    last_id: int

    @property
    def names(self) -> list[str]:
        return self.columns.fieldNames()


def number_fields(dtype: T.DataType, next_id: int) -> tuple[T.DataType, int]:
    """Give ids to the fields inside a type; children come before the field that holds them."""
    match dtype:
        case T.StructType():
            fields = []
            for f in dtype.fields:
                inner, next_id = number_fields(f.dataType, next_id)
                fields.append(T.StructField(f.name, inner, True, {**f.metadata, FIELD_ID: next_id}))
                next_id += 1
            return T.StructType(fields), next_id
        case T.ArrayType():
            inner, next_id = number_fields(dtype.elementType, next_id)
            return T.ArrayType(inner, True), next_id
        case T.MapType():
            key, next_id = number_fields(dtype.keyType, next_id)
            value, next_id = number_fields(dtype.valueType, next_id)
            return T.MapType(key, value, True), next_id
    return dtype, next_id


def declare(columns: T.StructType | Mapping[str, str], comments: Mapping[str, str] | None = None) -> TableSchema:
    """A table schema from a StructType or from written types. All columns are nullable."""
    written = None
    if not isinstance(columns, T.StructType):
        written = columns
        columns = T.StructType([T.StructField(n, spark_type(t)) for n, t in columns.items()])
    for name in comments or {}:
        if name not in columns.fieldNames():
            raise ValueError(f"no column {name}")
    written = written or {}
    described = T.StructType([
        T.StructField(f.name, f.dataType, True, {
            **({"comment": comments[f.name]} if comments and f.name in comments else {}),
            **({WRITTEN_TYPE: "uuid"} if written.get(f.name, "").strip().lower() == "uuid" else {}),
        })
        for f in columns.fields
    ])
    numbered, next_id = number_fields(described, 1)
    return TableSchema(numbered, next_id - 1)


@dataclass(frozen=True)
class SchemaChange:
    """One change of a column; ``column`` may be a dotted path into nested structs."""

    kind: str  # add, drop, rename or widen
    column: str
    type: str | None = None
    new_name: str | None = None
    comment: str | None = None


def _replace_at(struct: T.StructType, path: Sequence[str], edit) -> T.StructType:
    if len(path) == 1:
        return edit(struct, path[0])
    if path[0] not in struct.fieldNames():
        raise ValueError(f"no column {path[0]}")
    fields = []
    for f in struct.fields:
        if f.name == path[0]:
            if not isinstance(f.dataType, T.StructType):
                raise ValueError(f"{path[0]} has no inner columns")
            f = T.StructField(f.name, _replace_at(f.dataType, path[1:], edit), True, f.metadata)
        fields.append(f)
    return T.StructType(fields)


def change_schema(schema: TableSchema, change: SchemaChange) -> TableSchema:
    """The schema after one change. Refuses unknown columns, taken names and narrowing types."""
    last_id = schema.last_id

    def edit(struct: T.StructType, name: str) -> T.StructType:
        nonlocal last_id
        names = struct.fieldNames()
        if change.kind == "add":
            if name in names:
                raise ValueError(f"column {name} exists")
            inner, next_id = number_fields(spark_type(change.type), last_id + 1)
            last_id = next_id
            comment = {"comment": change.comment} if change.comment else {}
            return T.StructType([*struct.fields, T.StructField(name, inner, True, {**comment, FIELD_ID: next_id})])
        if name not in names:
            raise ValueError(f"no column {name}")
        at = names.index(name)
        old = struct.fields[at]
        match change.kind:
            case "drop":
                return T.StructType(struct.fields[:at] + struct.fields[at + 1:])
            case "rename":
                if change.new_name in names:
                    raise ValueError(f"column {change.new_name} exists")
                new = T.StructField(change.new_name, old.dataType, True, old.metadata)
            case "widen":
                wanted = spark_type(change.type)
                if not is_widening(old.dataType, wanted):
                    raise ValueError(f"{name}: {old.dataType.simpleString()} does not widen to {change.type}")
                new = T.StructField(name, wanted, True, old.metadata)
            case _:
                raise ValueError(f"unknown change {change.kind}")
        return T.StructType([*struct.fields[:at], new, *struct.fields[at + 1:]])

    columns = _replace_at(schema.columns, change.column.split("."), edit)
    return replace(schema, columns=columns, last_id=last_id)


def change_schema_to(schema: TableSchema, changes: Sequence[tuple[str, SchemaChange]],
                     version: str | None = None) -> TableSchema:
    """The schema as of a version: all (version, change) up to and including it, in version order."""
    for at, change in sorted(changes, key=lambda vc: vc[0]):
        if version is None or at[:13] <= version[:13]:
            schema = change_schema(schema, change)
    return schema


def _cast(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    match have, want:
        case T.StructType(), T.StructType():
            inner = {f.name: f.dataType for f in have.fields}
            parts = [
                (_cast(value.getField(f.name), inner[f.name], f.dataType) if f.name in inner
                 else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in want.fields
            ]
            return F.when(value.isNotNull(), F.struct(*parts))
        case T.ArrayType(), T.ArrayType():
            return F.transform(value, lambda x: _cast(x, have.elementType, want.elementType))
        case T.MapType(), T.MapType():
            values = F.transform_values(value, lambda _, v: _cast(v, have.valueType, want.valueType))
            if have.keyType == want.keyType:
                return values
            return F.transform_keys(values, lambda k, _: _cast(k, have.keyType, want.keyType))
    return value.cast(want)


def conform(df: DataFrame, schema: TableSchema | T.StructType) -> DataFrame:
    """Reorder, cast and fill ``df`` to a declared schema, inside nested types as well.

    The optimizer drops field ids along with projections it merges. An explicit alias carries
    the id of a column, and a cast to the declared type carries the ids inside it.
    """
    columns = schema.columns if isinstance(schema, TableSchema) else schema
    have = {f.name: f.dataType for f in df.schema.fields}
    selected = [
        (_cast(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None))
        .cast(f.dataType).alias(f.name, metadata=f.metadata)
        for f in columns.fields
    ]
    return df.select(selected)


def write_generation(df: DataFrame, schema: TableSchema, path: str) -> str:
    """Write files of one schema generation, with field ids."""
    conform(df, schema).write.parquet(path)
    return path


def read_generations(spark: SparkSession, schema: TableSchema, paths: Sequence[str]) -> DataFrame:
    """One scan over files of several generations under the newest schema.

    Columns are found by field id: a renamed column keeps its values, an added one is NULL in
    old files, a dropped one is not read, and a name used again does not show old values.
    """
    return spark.read.schema(schema.columns).parquet(*paths)


def narrowing_audit(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """How many values of each column would not survive a change to a narrower type. One pass."""
    def lost(name: str) -> Column:
        have, want = df.schema[name].dataType, spark_type(targets[name])
        value = F.col(name)
        if isinstance(have, T.StringType) and isinstance(want, T.IntegralType):
            # A failing cast of a text costs an exception per row; these texts cannot survive.
            value = F.when(value.rlike(r"^-?[0-9]{1,19}\z"), value)
        there_and_back = value.try_cast(want).try_cast(have)
        return F.count_if(~F.col(name).eqNullSafe(there_and_back))

    counts = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(df.schema[name].dataType.simpleString()).alias("old_type"),
            F.lit(target).alias("new_type"),
            F.count(F.lit(1)).alias("n_rows"),
            lost(name).alias("n_lost"),
        )
        for name, target in targets.items()
    ]
    return df.agg(F.array(*counts).alias("_audit")).select(F.inline("_audit"))


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two column inventories (table_name, field_id, column_name, column_type)."""
    key = ["table_name", "field_id"]
    old = before.select(*key, F.col("column_name").alias("old_name"), F.col("column_type").alias("old_type"))
    new = after.select(*key, F.col("column_name").alias("new_name"), F.col("column_type").alias("new_type"))
    renamed = F.col("old_name") != F.col("new_name")
    retyped = F.col("old_type") != F.col("new_type")
    change = (
        F.when(F.col("old_name").isNull(), "added")
        .when(F.col("new_name").isNull(), "dropped")
        .when(renamed & retyped, "renamed and retyped")
        .when(renamed, "renamed")
        .when(retyped, "retyped")
    )
    return old.join(new, key, "full_outer").withColumn("change", change).filter("change is not null")


def column_inventory(name: str, schema: TableSchema) -> list[tuple[str, int, str, str]]:
    """Rows of a column inventory for one table."""
    return [(name, f.metadata[FIELD_ID], f.name, f.dataType.simpleString()) for f in schema.columns.fields]
