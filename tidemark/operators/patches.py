"""Partial images: updates that name some columns only, and their inverse.

A patch has the key columns, ``version``, ``seq``, ``named`` (array of the columns it gives) and ``after``, a struct of
the columns of the table besides its keys. A column that is not named is absent, whatever ``after`` holds there; one that
is named and null becomes null. (version, seq) is unique per key. Keys are unique in the table; patches of a key that the
table does not have, null keys included, change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .skew import with_earlier


def _given(table: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in table.columns if c not in keys]


def patch_schema(table: T.StructType, keys: Sequence[str]) -> T.StructType:
    fields = [table[k] for k in keys]
    fields += [T.StructField("version", T.StringType()), T.StructField("seq", T.LongType()),
               T.StructField("named", T.ArrayType(T.StringType())),
               T.StructField("after", T.StructType([f for f in table if f.name not in keys]))]
    return T.StructType(fields)


def _names(columns: Sequence[str]) -> Column:
    """``named``, or a failed job where it holds something else than ``columns``; null names nothing."""
    known = F.forall("named", lambda c: F.coalesce(c.isin(*columns), F.lit(False)))
    message = F.concat(F.lit("no such column to patch: "), F.to_json("named"))
    none = F.array().cast("array<string>")
    return F.when(F.col("named").isNull(), none).when(known, F.col("named")).otherwise(
        F.raise_error(message).cast("array<string>"))


def _value(c: str, named: str, image: str) -> Column:
    """What a patch gives for a column. A struct around it tells a null that was given from a column that no patch names."""
    return F.when(F.array_contains(named, c), F.struct(F.col(image)[c].alias("value")))


def _patched(table: DataFrame, patches: DataFrame, keys: Sequence[str], image: str, newest: bool) -> DataFrame:
    columns = _given(table, keys)
    pick = F.max_by if newest else F.min_by
    at = F.struct("version", "seq")

    def folded(c: str) -> Column:
        return pick(_value(c, "_named", image), F.when(F.array_contains("_named", c), at)).alias(f"_{c}")

    per_key = patches.withColumn("_named", _names(columns)).groupBy(*keys).agg(*map(folded, columns))
    # Once written its size is known: a few patched keys never shuffle the table.
    joined = table.join(materialize(per_key, "patches"), list(keys), "left")
    values = {c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}")["value"]).otherwise(F.col(c)) for c in columns}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in table.columns])


def apply_patches(table: DataFrame, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the patches: of every row and column the value given last.

    One aggregate by key with map-side combining, so a key with a third of all patches sends one row per task.
    """
    return _patched(table, patches, keys, "after", True)


def revert_patches(table: DataFrame, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table before the patches of :func:`with_before`: of every row and column the value before the first that gave it."""
    return _patched(table, patches, keys, "before", False)


def with_before(table: DataFrame, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``patches`` of keys in the table, with ``before``: what each named column was when the patch came, null for the others.

    ``table`` is the one before all patches. Patches and the rows of the table that they meet lie in the order of (key, version, seq), one row
    each; the newest value so far of every column is carried over range partitions, so no task holds a hot key.
    """
    columns = _given(table, keys)
    own = patches.select(*keys, "version", "seq", _names(columns).alias("named"), "after")
    own = materialize(own.join(table.select(*keys), list(keys), "left_semi"), "patches")
    # Nulls come first in the order, so the row of the table is the oldest value but for patches without version and seq.
    base = table.join(own.select(*keys), list(keys), "left_semi").select(
        *keys, F.lit(None).cast("string").alias("version"), F.lit(None).cast("long").alias("seq"),
        F.array(*map(F.lit, columns)).alias("named"), F.struct(*columns).cast(own.schema["after"].dataType).alias("after"),
        F.lit(True).alias("_base"))
    points = own.withColumn("_base", F.lit(False)).unionByName(base)
    was = {f"_was_{c}": _value(c, "named", "after") for c in columns}
    found = with_earlier(points, keys, [F.col("version"), F.col("seq"), F.col("_base")], was).filter("not _base")
    known = (F.size("named") > 0) & F.col("version").isNotNull() & F.col("seq").isNotNull()
    before = F.struct(*[F.when(F.array_contains("named", c), F.col(f"_was_{c}")["value"]).alias(c) for c in columns])
    return found.select(*keys, "version", "seq", "named", "after", F.when(known, before).alias("before"))
