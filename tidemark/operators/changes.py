"""Change sets on table data: apply, revert, read as of a version, redo.

A change set has the key columns, ``version``, ``seq``, ``op`` (insert, update or delete) and
the row images ``before`` and ``after`` as structs of all table columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import version_key
from ..session import materialize


def change_schema(table: T.StructType, keys: Sequence[str]) -> T.StructType:
    fields = [table[k] for k in keys]
    fields += [T.StructField("version", T.StringType()), T.StructField("seq", T.LongType()),
               T.StructField("op", T.StringType()), T.StructField("before", table),
               T.StructField("after", table)]
    return T.StructType(fields)


def _replace_rows(table: DataFrame, per_key: DataFrame, keys: Sequence[str], image: str, gone: str) -> DataFrame:
    # Written once because both branches read it. Its size on disk is then known, so the
    # anti-join broadcasts a small change set and the table itself is not shuffled.
    changed = materialize(per_key, "changes")
    kept = table.join(changed.select(*keys), list(keys), "left_anti")
    message = F.concat(F.lit(f"no image {image} the "), F.col("op"), F.lit(" of a row"))
    whole = F.when(F.col(image).isNotNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    rows = changed.filter(F.col("op") != gone).filter(whole).select(f"{image}.*")
    return kept.unionByName(rows.select(*table.columns))


def apply_changes(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the changes; the last change of each key counts. Fails if its image is missing."""
    last = changes.groupBy(*keys).agg(
        F.max_by(F.struct("op", "after"), F.struct("version", "seq")).alias("last")
    ).select(*keys, "last.*")
    return _replace_rows(table, last, keys, "after", "delete")


def revert_changes(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table before the changes; the first change of each key holds the older image.

    Fails if that image is missing; see :func:`irreversible`.
    """
    first = changes.groupBy(*keys).agg(
        F.min_by(F.struct("op", "before"), F.struct("version", "seq")).alias("first")
    ).select(*keys, "first.*")
    return _replace_rows(table, first, keys, "before", "insert")


def irreversible(changes: DataFrame) -> DataFrame:
    """Changes that cannot be reverted because the image before them is missing."""
    return changes.filter((F.col("op") != "insert") & F.col("before").isNull())


def up_to(changes: DataFrame, version: str) -> DataFrame:
    return changes.filter(version_key("version") <= version[:13])


def after(changes: DataFrame, version: str) -> DataFrame:
    return changes.filter(version_key("version") > version[:13])


def table_as_of(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The original table with every change up to and including the version."""
    return apply_changes(table, up_to(changes, version), keys)


def newest_versions(changes: DataFrame, n: int) -> DataFrame:
    """The changes of the newest ``n`` versions."""
    if n < 1:
        raise ValueError("n must be at least 1")
    newest = changes.select("version").distinct().orderBy(F.desc("version")).limit(n)
    oldest = newest.agg(F.min("version").alias("_oldest"))
    return changes.crossJoin(F.broadcast(oldest)).filter("version >= _oldest").drop("_oldest")


def redo(table: DataFrame, changes: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Revert the newest ``n`` versions of an applied table and apply them again."""
    last = newest_versions(changes, n)
    return apply_changes(revert_changes(table, last, keys), last, keys)
