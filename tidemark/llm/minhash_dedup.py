"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Each text becomes its set of 5-word shingle hashes; the 64 smallest are its sketch.
   Documents with the same set are one item from here on.
2. Inverted lists over the retained values. A pair with a similarity of 0.75 shares about 48 of the
   64 smallest values of its union, and fewer than 28 with a probability of about 1e-8. So it
   also shares one of the 37 rarest values of either sketch, and only those are listed: a passage
   that many documents quote is common, hence rarely among them.
3. Items that met another in a list are hashed again in full. The same rule on their whole sets, where it
   is exact (a quarter of the set), makes their lists short: a text with its own quarter leaves them.
4. Members of a list meet in rounds (``linking``). The union sketch of a pair, the 64 smallest
   values of both, estimates the similarity and drops clear cases; only pairs that stay fetch their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .columns import WORD
from .linking import linked_components, similar

SHINGLE = 5
PERCENT = 75
SKETCH = 64
NEED = 28
_SIGN = np.uint64(1 << 63)


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text."""
    for low, high in W.slices(texts, W.PIECE_BYTES):
        data, offsets = W.buffers(texts.slice(low, high - low))
        hashes, _, _, first = W.hashed_words(data, offsets)
        for i in range(high - low):
            yield low + i, np.unique(W.shingle_hashes(hashes[first[i]:first[i + 1]], SHINGLE))


def _signed(values: np.ndarray) -> np.ndarray:
    """Unsigned order kept in Spark's signed longs."""
    return (values ^ _SIGN).view(np.int64)


def _fingerprint(values: np.ndarray) -> bytes | None:
    if not len(values):
        return None
    parts = W.mix(values + np.uint64(1)), W.mix(values ^ np.uint64(0x5851F42D4C957F2D))
    return b"".join(int(p.sum(dtype=np.uint64)).to_bytes(8, "big") for p in parts)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int64()))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in W.slices(batch.column(1), W.PIECE_BYTES):
            n, prints, rows = [], [], []
            for _, values in _sets(batch.column(1).slice(low, high - low)):
                n.append(len(values))
                prints.append(_fingerprint(values))
                # A copy: a view would keep the whole set.
                rows.append(_signed(values[:SKETCH].copy()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), _lists(rows)],
                ["id", "n", "item", "sketch"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in W.slices(batch.column(0), W.PIECE_BYTES):
            prints, rows = [], []
            for _, values in _sets(batch.column(0).slice(low, high - low)):
                prints.append(_fingerprint(values))
                rows.append(_signed(values))
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), _lists(rows)], ["item", "shingles"])


def sketches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n, item, sketch) of each row; ``item`` is the 128-bit fingerprint of the set, null if empty."""
    id_type = docs.schema[id_column].dataType.simpleString()
    return (
        docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
        .mapInArrow(_sketch_batches, f"id {id_type}, n bigint, item binary, sketch array<bigint>")
    )


def _need(n: Column) -> Column:
    """Values that the sketches of a linked pair share at least, where the smaller one keeps ``n``."""
    return F.least(F.ceil(n * PERCENT / 100), F.lit(NEED)).cast("int")


def _estimated(a: Column, b: Column) -> Column:
    """Whether the union sketch leaves a link possible."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return shared >= _need(F.size(union))


def _key(df: Column, value: Column) -> Column:
    """One long that orders values by their number of items, in powers of two, then by value.

    Values that fall on one key count as one; their items are compared more often and lose no link.
    """
    return F.shiftleft(F.length(F.bin(df)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(value, 8))


def rare_postings(items: DataFrame, values: str, need: Column, passes: int = 1) -> DataFrame:
    """(key, item, n, left): of each item's ``values`` (array of long) the rarest that a linked pair cannot all miss.

    A pair that shares ``need`` values also shares one of the size - need + 1 that come first in any
    common order; here that is the order of ``key``. Values of one item alone come first of all and are not returned.
    ``left`` counts the values from the key on, itself included. Values that more than a thousandth of all postings hold, fewer
    than 1000 of them, never leave the tasks that read them before their counts are known. With several ``passes`` each
    takes its part of the items and is written, so that only its own postings are shuffled at once.
    """
    postings = items.select("item", F.explode(values).alias("value"))
    counts = materialize(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "counts")
    total = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    is_hot = F.col("df") * 1000 > F.lit(total)
    key = _key(F.col("df"), F.col("value")).alias("key")
    hot = F.broadcast(counts.filter(is_hot).select("value", key))

    def rarest(items: DataFrame) -> DataFrame:
        postings = items.select("item", F.explode(values).alias("value"))
        cold = postings.join(hot, "value", "left_anti").join(counts.filter(~is_hot).select("value", key), "value")
        listed = (
            cold.select("item", "key").unionAll(postings.join(hot, "value").select("item", "key"))
            .groupBy("item").agg(F.sort_array(F.collect_list("key")).alias("shared"))
            .join(items.select("item", "n", need.alias("need")), "item")
        )
        room = F.size("shared") - F.col("need") + 1
        return (
            listed.filter(room > 0)
            .select("item", "n", F.size("shared").alias("size"), F.posexplode(F.slice("shared", F.lit(1), room)).alias("at", "key"))
            .select("key", "item", "n", (F.col("size") - F.col("at")).alias("left"))
        )

    if passes == 1:
        return rarest(items)
    turn = F.pmod(F.xxhash64("item"), F.lit(passes))
    return reduce(DataFrame.unionByName, [materialize(rarest(items.filter(turn == i)), "parts") for i in range(passes)])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of ``docs``.

    Linked: 100 * shared shingles >= 75 * all shingles of both. ``component_id`` is the smallest id
    that links reach. A null or wordless text has no shingles and no links; its component is its
    own id. A null id ranks last: it is a component id only where the whole component has
    none. ``kept``: the id equals the component id, two nulls being equal. Repeated rows give repeated
    results. Other columns of ``docs`` are not read; an empty table gives an empty one.
    """
    rows = materialize(sketches(docs, id_column, text_column), "sketches")
    # Once written, the numbers stay as they are.
    items = materialize(
        rows.filter(F.col("item").isNotNull()).groupBy(F.col("item").alias("print"))
        .agg(F.min("id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("item", F.monotonically_increasing_id()), "items")
    listed = materialize(rare_postings(items, "sketch", _need(F.size("sketch"))), "postings")
    shared = listed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    met = materialize(
        items.select("item", "print", "low").join(listed.join(shared, "key", "left_semi").select("item").distinct(), "item"), "met")
    # One document stands for each item that met another; only their texts are hashed again.
    texts = docs.select(F.col(id_column).alias("low"), F.col(text_column).cast("string").alias("text"))
    chosen = met.select("low").distinct()
    full = materialize(
        texts.join(chosen, texts["low"].eqNullSafe(chosen["low"]), "left_semi").select("text")
        .mapInArrow(_set_batches, "item binary, shingles array<bigint>").withColumnRenamed("item", "print")
        .join(met.select("print", "item"), "print").dropDuplicates(["print"]).select("item", "shingles"), "sets")
    full = full.withColumn("n", F.size("shingles").cast("long"))
    members = materialize(rare_postings(full, "shingles", F.ceil(F.col("n") * PERCENT / 100).cast("int")), "postings")

    def both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``pairs`` with the sets (item, values) of both as ``of_a`` and ``of_b``."""
        a, b = (sets.toDF(c, f"of_{c}") for c in "ab")
        return pairs.join(a, "a").join(b, "b")

    def check(pairs: DataFrame) -> DataFrame:
        judged = both(pairs, items.select("item", "sketch")).withColumn("linked", _estimated(F.col("of_a"), F.col("of_b")))
        judged = materialize(judged.drop("of_a", "of_b"), "estimates")
        likely = both(judged.filter("linked"), full.select("item", "shingles"))
        exact = likely.withColumn("linked", similar(F.col("of_a"), F.col("of_b"), PERCENT)).drop("of_a", "of_b")
        return exact.unionByName(judged.filter(~F.col("linked")))

    found = linked_components(members, check, PERCENT)
    # A component may hold a third of all items: its smallest id is an aggregate, joined back.
    low = found.join(items.select("item", "low"), "item").groupBy("component").agg(F.min("low").alias("reached"))
    lowest = found.join(low, "component").select("item", "reached")
    known = materialize(items.select("item", "print", "low").join(lowest, "item", "left").select(
        F.col("print").alias("item"), F.coalesce("reached", "low").alias("component_id")), "reached")
    done = rows.select("id", F.col("n").alias("n_shingles"), "item").join(known, "item", "left")
    component = F.when(F.col("item").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return done.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept, in all their columns.

    Of a component the document whose id is the component's stays; among several rows of that id, one with the
    smallest text digest. Rows without words have no links and all stay.
    """
    identity, text = F.col(id_column), F.col(text_column).cast("string")
    at = F.struct(identity.isNull().alias("unnamed"), identity.alias("id"), F.md5(text).alias("digest"))
    has_words = F.coalesce(F.rlike(text, F.lit(WORD)), F.lit(False))
    found = near_duplicates(docs.filter(has_words).select(at.alias("at"), text.alias("text")), "at", "text")
    stays = materialize(found.select(F.col("component_id").alias("__at")).distinct(), "stays")
    one = docs.filter(has_words).withColumn("__at", at).join(stays, "__at", "left_semi").dropDuplicates(["__at"])
    return one.select(*docs.columns).unionByName(docs.filter(~has_words))
