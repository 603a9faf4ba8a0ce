"""Repeated passages by the smallest shingle hashes of paragraphs.

A paragraph is 20 words that begin at an anchor: among every 28 neighbouring three-word
positions the one with the smallest hash is an anchor, so equal passages have equal anchors wherever they
stand, and a passage of 50 words holds at least one whole paragraph. Texts need no line ends for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, passing
from . import words as W
from .linking import linked_components, similar
from .minhash_dedup import rare_postings

LENGTH, ANCHOR, REACH = 20, 3, 28
SHINGLE, PERCENT = 5, 75
_INDEX = np.arange(LENGTH - SHINGLE + 1)
#: Linked paragraphs share at least 75 of 100 shingles of either, so also one of the smallest n - ceil(0.75 n) + 1 of each; this
#: is the most that any number n of different shingles needs.
SMALLEST = max(n - -(-n * PERCENT // 100) + 1 for n in range(1, len(_INDEX) + 1))
#: Linked paragraphs that both have all their shingles different miss at most two of the other's, so they share three of their smallest.
SHARED = SMALLEST - (len(_INDEX) - -(-2 * len(_INDEX) * PERCENT // (100 + PERCENT)))
#: Passes over the smallest shingles, by key, and over the postings, by item: each shuffles its part only.
KEY_PASSES, ITEM_PASSES = 3, 4


def anchors(words: np.ndarray) -> np.ndarray:
    """First words of the paragraphs of one text."""
    n = len(words) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keys = W.shingle_hashes(words, ANCHOR)
    if len(keys) <= REACH:
        picked = np.array([int(keys.argmin())])
    else:
        seen = np.lib.stride_tricks.sliding_window_view(keys, REACH)
        picked = np.unique(seen.argmin(1) + np.arange(len(seen)))
    return picked[picked < n]


def _prints(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of paragraphs by their shingles in order."""
    marks = W.mix(np.arange(1, 2 * len(_INDEX) + 1, dtype=np.uint64)) | np.uint64(1)
    parts = [W.mix((shingles * marks[i * len(_INDEX):(i + 1) * len(_INDEX)]).sum(1, dtype=np.uint64)) for i in (0, 1)]
    return np.ascontiguousarray(np.stack(parts, 1))


def _paragraphs(texts: pa.Array) -> Iterator[tuple]:
    """Per slice: text numbers, first words, first and last code point, shingles (paragraphs x 16), fingerprints."""
    for low, high in W.slices(texts, W.PIECE_BYTES):
        data, offsets = W.buffers(texts.slice(low, high - low))
        words, start, end, first = W.hashed_words(data, offsets)
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        found = [anchors(words[first[i]:first[i + 1]]) for i in range(high - low)]
        text = np.repeat(np.arange(high - low), [len(f) for f in found])
        at = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
        place = at + first[text]
        if len(place):
            shingles = W.shingle_hashes(words, SHINGLE)[place[:, None] + _INDEX]
        else:
            shingles = np.zeros((0, len(_INDEX)), np.uint64)
        prints = _prints(shingles)
        begin = points[offsets[:-1]][text]
        yield low, text, at, points[start[place]] - begin, points[end[place + LENGTH - 1]] - begin, shingles, prints


def _binary(prints: np.ndarray) -> pa.Array:
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(prints), [None, pa.py_buffer(prints.tobytes())])
    return fixed.cast(pa.binary())


def _lists(values: np.ndarray) -> pa.Array:
    sizes = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(sizes, pa.array(values.view(np.int64).ravel()))


def _again(found: np.ndarray) -> np.ndarray:
    again = np.zeros(found.shape, bool)
    again[:, 1:] = found[:, 1:] == found[:, :-1]
    return again


def smallest(shingles: np.ndarray) -> np.ndarray:
    """The ``SMALLEST`` smallest different shingles of each paragraph; the smallest again where there are fewer."""
    found = np.sort(shingles, 1)
    again = _again(found)
    order = np.argsort(again, 1, kind="stable")[:, :SMALLEST]
    return np.where(np.take_along_axis(again, order, 1), found[:, :1], np.take_along_axis(found, order, 1))


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, text, at, begin, end, shingles, prints in _paragraphs(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(low + text)), pa.array(at.astype(np.int32)), pa.array(begin.astype(np.int32)),
                 pa.array(end.astype(np.int32)), _binary(prints), _lists(np.ascontiguousarray(smallest(shingles))),
                 pa.array(_again(np.sort(shingles, 1)).any(1))],
                ["id", "word", "start", "end", "item", "smallest", "short"])


def _asked(texts: pa.Array, asked: pa.Array) -> Iterator[tuple]:
    """Per slice: its first row, words (hash, start, end, first of each text), shingles, and per asked paragraph (``word``, ``item``, ...)
    its text and place in ``asked`` and its first word, counted in the text and in the slice, and its fingerprint."""
    for low, high in W.slices(texts, W.PIECE_BYTES):
        data, offsets = W.buffers(texts.slice(low, high - low))
        words, start, end, first = W.hashed_words(data, offsets)
        if len(words) < LENGTH:
            continue
        rows = asked.slice(low, high - low)
        text = np.repeat(np.arange(high - low), rows.value_lengths().to_numpy())
        rows = rows.flatten()
        word = rows.field("word").to_numpy()
        prints = np.frombuffer(b"".join(rows.field("item").to_pylist()), np.uint64).reshape(-1, 2)
        # Of rows equal in id, only those whose text has the paragraph there.
        fits = np.flatnonzero(word + LENGTH <= first[text + 1] - first[text])
        shingles = W.shingle_hashes(words, SHINGLE)
        fits = fits[(_prints(shingles[(first[text] + word)[fits][:, None] + _INDEX]) == prints[fits]).all(1)]
        yield low, (data, offsets, words, start, end, first), shingles, rows.take(pa.array(fits)), text[fits], word[fits], prints[fits]


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, (*_, first), shingles, rows, text, word, _ in _asked(batch.column(0), batch.column(1)):
            found = shingles[(first[text] + word)[:, None] + _INDEX]
            yield pa.RecordBatch.from_arrays([rows.field("number"), _lists(found)], ["item", "shingles"])


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 1 to ``REACH`` words before (side 0) or behind (side 1) the asked paragraphs, each as one key with the paragraph's item."""
    steps = np.arange(REACH)
    weights = W.mix(np.arange(1, REACH + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        for low, (data, offsets, words, start, end, first), _, rows, text, word, prints in _asked(batch.column(1), batch.column(2)):
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            side = rows.field("side").to_numpy()
            grows = rows.field("grows").to_numpy(zero_copy_only=False)
            at = (first[text] + word)[:, None] + np.where(side[:, None] == 0, -1 - steps, LENGTH + steps)
            inside = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
            at = np.clip(at, 0, len(words) - 1)
            keys = W.mix(np.cumsum(np.where(inside, words[at], np.uint64(0)) * weights, 1, dtype=np.uint64)
                         + (2 * steps + 2 + side[:, None]).astype(np.uint64))
            edge = np.where(side[:, None] == 0, points[start[at]], points[end[at]]) - points[offsets[:-1]][text][:, None]
            row, step = np.nonzero(inside)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(low + text[row])), pa.array(word[row].astype(np.int32)),
                 pa.array(side[row].astype(np.int32)), _binary(np.ascontiguousarray(prints[row])),
                 pa.array(keys[row, step].view(np.int64)), pa.array((step + 1).astype(np.int32)),
                 pa.array(edge[row, step].astype(np.int32)), pa.array(grows[row])],
                ["id", "word", "side", "item", "key", "reach", "edge", "grows"])


def _extended(runs: DataFrame, texts: DataFrame, places: DataFrame, items: DataFrame) -> DataFrame:
    """``runs`` with the words before and behind them that an earlier document has in the same place too.

    The first and the last paragraph of a run are looked up with the 1, 2, ... words that go on from them in every text that
    has the paragraph. A passage that repeats ends less than ``REACH`` words behind its last paragraph, and so before its first.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    ends = runs.select("id", "run", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("first.word").alias("word"), F.col("first.item").alias("item")),
        F.struct(F.lit(1).alias("side"), F.col("last.word").alias("word"), F.col("last.item").alias("item")))))
    wanted = ends.select("item", "side").distinct().join(items.filter("low < high").select("item"), "item", "left_semi")
    grows = ends.select("id", "word", "side").distinct().withColumn("grows", F.lit(True))
    asked = (
        places.select("id", "word", "item").join(wanted, "item").distinct().join(grows, ["id", "word", "side"], "left")
        .groupBy("id").agg(F.collect_list(F.struct("word", "item", "side", F.col("grows").isNotNull().alias("grows"))).alias("asked"))
    )
    contexts = materialize(texts.join(asked, "id").select("id", "text", "asked").mapInArrow(
        _context_batches, f"id {id_type}, word int, side int, item binary, key bigint, reach int, edge int, grows boolean"), "contexts")
    earliest = contexts.groupBy("item", "key").agg(F.min("id").alias("low"))
    grown = (
        contexts.filter("grows").join(earliest, ["item", "key"]).filter(F.col("id") > F.col("low"))
        .groupBy("id", "word", "side").agg(F.max(F.struct("reach", "edge")).alias("far"))
    )
    by_run = (
        ends.join(grown, ["id", "word", "side"]).groupBy("id", "run")
        .agg(*[F.max(F.when(F.col("side") == n, F.col("far"))).alias(c) for n, c in enumerate(("before", "behind"))])
    )
    return runs.join(by_run, ["id", "run"], "left").select(
        "id", "kept_id",
        (F.col("first.word") - F.coalesce("before.reach", F.lit(0))).alias("from"),
        (F.col("last.word") + LENGTH + F.coalesce("behind.reach", F.lit(0))).alias("to"),
        F.coalesce("before.edge", "first.start").alias("start"), F.coalesce("behind.edge", "last.end").alias("end"))


def _met(paragraphs: DataFrame, items: DataFrame) -> DataFrame:
    """(item, id, word, number) of the ``items`` that may be linked: where they come first, and a number.

    A linked pair shares one of the smallest shingles of both, and ``SHARED`` of them if both have all their shingles different. So an item
    stays if it meets others in that many keys, or in one that holds an item with repeated shingles.
    """
    # Keys travel with 8 bytes of their item: a key that two items have meets two prints.
    print_ = F.xxhash64("item").alias("print")
    keys = paragraphs.select(print_, "short", F.posexplode("smallest").alias("at", "key"))
    seen = None
    for turn in range(KEY_PASSES):
        part = keys.filter(F.pmod("key", F.lit(KEY_PASSES)) == turn)
        crowded = (
            part.groupBy("key").agg(F.min("print").alias("least"), F.max("print").alias("most"), F.max("short").alias("loose"))
            .filter("least < most").select("key", "loose")
        )
        found = materialize(
            part.select("print", "at", "key").join(crowded, "key").groupBy("print")
            .agg(F.bit_or(F.expr("shiftleft(1, at)")).alias("shared"), F.max("loose").alias("loose")), "crowded")
        seen = found if seen is None else seen.unionByName(found)
    prints = (
        seen.groupBy("print").agg(F.bit_count(F.bit_or("shared")).alias("shared"), F.max("loose").alias("loose"))
        .filter(F.col("loose") | (F.col("shared") >= SHARED)).select("print")
    )
    return items.select("item", "first.*", print_).join(prints, "print", "left_semi").drop("print").withColumn(
        "number", F.monotonically_increasing_id())


def _shingles(texts: DataFrame, met: DataFrame) -> DataFrame:
    """(item, shingles, n) of the ``met`` items, read where each comes first; ``item`` is the number."""
    asked = met.groupBy("id").agg(F.collect_list(F.struct("word", "item", "number")).alias("asked"))
    full = materialize(texts.join(asked, "id").select("text", "asked").mapInArrow(
        _shingle_batches, "item bigint, shingles array<bigint>").withColumn("shingles", F.array_distinct("shingles")), "shingles")
    if not full.groupBy("item").count().filter("count > 1").isEmpty():
        # Rows equal in id that have the paragraph in the same place.
        full = materialize(full.dropDuplicates(["item"]), "shingles")
    return full.withColumn("n", F.size("shingles").cast("long"))


def _clusters(texts: DataFrame, id_type: str) -> tuple[DataFrame, DataFrame]:
    """All paragraphs, and (item, low, high, cluster) of the items that have copies or links; written as places and clusters."""
    with passing(texts.sparkSession, but=("items", "met", "places")):
        paragraphs = materialize(texts.mapInArrow(
            _place_batches,
            f"id {id_type}, word int, start int, end int, item binary, smallest array<bigint>, short boolean"), "paragraphs")
        # Equal paragraphs are one item.
        items = materialize(
            paragraphs.groupBy("item").agg(F.min(F.struct("id", "word")).alias("first"), F.max("id").alias("high")), "items")
        # Once written, the numbers stay as they are; lists and rounds carry them in place of the items.
        met = materialize(_met(paragraphs, items), "met")
        places = materialize(paragraphs.drop("smallest", "short"), "places")
    full = _shingles(texts, met)
    need = F.ceil(F.col("n") * PERCENT / 100).cast("int")
    with passing(texts.sparkSession, but=("postings",)):
        members = materialize(rare_postings(full, "shingles", need, ITEM_PASSES), "postings")

    def check(pairs: DataFrame) -> DataFrame:
        a = full.select(F.col("item").alias("a"), F.col("shingles").alias("of_a"))
        b = full.select(F.col("item").alias("b"), F.col("shingles").alias("of_b"))
        linked = similar(F.col("of_a"), F.col("of_b"), PERCENT)
        return pairs.join(a, "a").join(b, "b").withColumn("linked", linked).drop("of_a", "of_b")

    linked = linked_components(members, check, PERCENT).withColumnRenamed("item", "number")
    linked = met.select("item", "number").join(linked, "number").select("item", "component")
    spread = (
        items.select("item", F.col("first.id").alias("low"), "high").join(linked, "item", "left")
        # An item without links is a cluster of its own; its 32 digits are no number of another.
        .withColumn("cluster", F.coalesce(F.col("component").cast("string"), F.hex("item")))
    )
    spread = spread.filter(F.col("component").isNotNull() | (F.col("low") < F.col("high")))
    return places, materialize(spread.select("item", "low", "high", "cluster"), "clusters")


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start, end, n_words, kept_id): every passage of a document that an earlier document has too.

    Paragraphs count as the same if 100 * shared >= 75 * all five-word shingles, directly or over a chain of
    others; letters A-Z count as small ones. Of each cluster the document with the smallest id,
    ``kept_id``, keeps its text. In all others the paragraphs are to be removed; those of a text that begin at most
    28 words apart (two anchors are never further, so at most 8 words lie between) make one row, from code point ``start`` to before ``end``, ``kept_id`` being the smallest of theirs. A row
    goes on to both sides as far as an earlier document has the same words next to the same paragraph; rows that then meet are one. A passage of 50 words or more
    that repeats exactly is always found, from its first to its last word; one that repeats within one document only is
    not reported. Texts of fewer than 20 words, null texts and rows with a null id take no part;
    rows equal in id are one document. Other columns are not read.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    with passing(docs.sparkSession, but=("places", "clusters")):
        places, spread = _clusters(texts, id_type)
    across = spread.groupBy("cluster").agg(F.min("low").alias("kept_id"), F.max("high").alias("high")).filter("kept_id < high")
    owners = spread.join(across, "cluster").select("item", "kept_id")
    gone = places.select("id", "word", "start", "end", "item").join(owners, "item").filter(F.col("id") > F.col("kept_id"))
    in_text = Window.partitionBy("id").orderBy("word")
    reached = F.max(F.col("word") + REACH).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    opened = gone.withColumn("opens", (F.coalesce(reached, F.lit(-1)) < F.col("word")).cast("int"))
    runs = materialize(
        opened.withColumn("run", F.sum("opens").over(in_text)).groupBy("id", "run")
        .agg(F.min(F.struct("word", "start", "item")).alias("first"), F.max(F.struct("word", "end", "item")).alias("last"),
             F.min("kept_id").alias("kept_id")), "runs")
    spans = _extended(runs, texts, places, spread)
    in_text = Window.partitionBy("id").orderBy("from", "to")
    reached = F.max("to").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", (F.coalesce(reached, F.lit(-1)) < F.col("from")).cast("int"))
    return (
        opened.withColumn("run", F.sum("opens").over(in_text)).groupBy("id", "run")
        .agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"),
             (F.max("to") - F.min("from")).cast("long").alias("n_words"), F.min("kept_id").alias("kept_id"))
        .drop("run")
    )
