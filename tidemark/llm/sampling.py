"""Bounded samples that are the same each time, found without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS, _STEP = 60, 12


def _place(key: Column, seed: int) -> Column:
    """A hash of ``_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 64 - _BITS)


def smallest_hashes(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` of the ``rows``, by the smallest hashes of ``key``; all of them if there are no more than n.

    Keys should be unique. A histogram of the hash's leading bits finds the bucket in which the n-th row lies, and that
    bucket alone is refined until it holds less than a sixteenth of n; no task and not the driver sees more than
    the histogram.
    """
    prefix, taken, shift = 0, 0, _BITS
    placed = rows.select(_place(F.col(key), seed).alias("h"))
    while shift > 0:
        shift -= _STEP
        inside = placed.filter(F.shiftrightunsigned("h", shift + _STEP) == prefix)
        # At most 4096 rows.
        counts = dict(inside.groupBy(F.shiftrightunsigned("h", shift).bitwiseAND((1 << _STEP) - 1).alias("at")).count().collect())
        boundary = None
        for at in sorted(counts):
            if taken + counts[at] > n:
                boundary = at
                break
            taken += counts[at]
        if boundary is None:
            return rows
        prefix = prefix << _STEP | boundary
        if counts[boundary] * 16 <= n:
            break
    return rows.filter(_place(F.col(key), seed) < F.lit(prefix << shift))


def settled_labels(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """(id, label): one row per id whose labels of 0 or 1 agree; null ids, other labels and contradictions are left out."""
    known = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
    each = known.groupBy(F.col(id_column).alias("id")).agg(F.min(label_column).cast("int").alias("label"),
                                                           F.max(label_column).cast("int").alias("most"))
    return each.filter(F.col("label") == F.col("most")).drop("most")
