"""Repeated runs of lines by prefix doubling over line ranks, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Characters that a later copy must have to be deleted.
MIN_CHARS = 50


def _document(id_column: str, text_column: str) -> Column:
    """What a document is known by: its id, null last, and its text. Structs compare field by field, null with null."""
    identity, text = F.col(id_column), F.col(text_column).cast("string")
    return F.struct(identity.isNull().alias("unnamed"), identity.alias("id"), F.unhex(F.md5(text)).alias("digest"))


def _ranked(classes: DataFrame, *order: str) -> DataFrame:
    """``classes`` with ``rank``, which grows in the given order; written, so that ranks stay as they are."""
    return materialize(classes.sort(*order).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _shortest_windows(state: DataFrame, min_chars: int) -> DataFrame:
    """(doc, pos, size): the shortest windows of at least ``min_chars`` characters from each line on, and up to each line.

    ``state`` (doc, pos, chars) holds the lines that stand more than once; a window lies within neighbouring ones. A run of
    neighbours that is long enough is covered by the shortest windows inside it, and what they hold alone says
    where they begin and end. So the runs of every length that stand earlier cover what these windows cover.
    """
    number = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    blocks = state.select("doc", "pos", "chars", (F.col("pos") - number).alias("block"))
    in_block = Window.partitionBy("doc", "block")
    before = F.sum("chars").over(in_block.orderBy("pos")) - F.col("chars")
    last = F.lead("pos").over(in_block.orderBy("pos")).isNull()
    # One more row behind each block: its end.
    edges = (
        blocks.withColumn("before", before).withColumn("last", last)
        .withColumn("step", F.explode(F.when(F.col("last"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("doc", "block", (F.col("pos") + F.col("step")).alias("pos"), (F.col("before") + F.col("step") * F.col("chars")).alias("before"))
    )
    far = Window.unboundedPreceding, -max(min_chars, 0)
    low = F.max("pos").over(in_block.orderBy("before").rangeBetween(*far))
    high = F.min("pos").over(in_block.orderBy(F.desc("before")).rangeBetween(*far))
    found = edges.select("doc", "pos", F.min("pos").over(in_block).alias("from"), F.max("pos").over(in_block).alias("upto"),
                         F.when(low.isNotNull(), F.least(low, F.col("pos") - 1)).alias("low"),
                         F.when(high.isNotNull(), F.greatest(high, F.col("pos") + 1)).alias("high"))
    up_to = found.filter(F.col("low") >= F.col("from")).select(
        "doc", F.col("low").alias("pos"), (F.col("pos") - F.col("low")).alias("size"))
    onward = found.filter(F.col("high") <= F.col("upto")).select("doc", "pos", (F.col("high") - F.col("pos")).alias("size"))
    return up_to.union(onward).distinct()


def later_copies(docs: DataFrame, id_column: str, text_column: str, min_chars: int, every_length: bool = True) -> DataFrame:
    """(doc, pos, end): windows of lines, from ``pos`` to before ``end``, that stand earlier too.

    With ``every_length`` they cover all runs of lines of at least ``min_chars`` characters that stand earlier, otherwise
    those of 1, 2, 4, ... lines. A window of k to 2k lines is known by its size and the ranks of its first and last k lines.

    The suffixes of all line sequences are sorted by their first 1, 2, 4, ... lines: a suffix
    has the rank of its first 2k lines from its rank by k lines and that of the suffix k lines later. Suffixes of one rank form
    an interval of the suffix array with a common prefix of k lines; its first member is the copy
    that stays. A prefix that occurs once sorts its suffix for good, so only repeated ones
    go on, and the rounds end when no window repeats.
    """
    text = F.col(text_column).cast("string")
    # Named before the lines are taken apart: once per document, not once per line.
    named = docs.filter(text.isNotNull()).select(_document(id_column, text_column).alias("doc"), text.alias("text"))
    lines = materialize(
        named.select("doc", F.posexplode(F.split("text", "\n")))
        .select("doc", "pos", F.unhex(F.md5("col")).alias("line"), F.length("col").cast("long").alias("chars")), "lines")
    shared = lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line")
    # Equal rows are one document: their lines count once.
    state = materialize(lines.join(_ranked(shared, "line"), "line").select("doc", "pos", "chars", "rank").distinct(), "state")
    windows = materialize(_shortest_windows(state, min_chars), "windows") if every_length else None
    found = None
    length = 1
    while True:
        place = F.struct("doc", "pos")
        classes = state.groupBy("rank").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
        state = materialize(state.join(classes.select("rank", "first"), "rank"), "state")
        if every_length:
            copies = _copies_of(windows.filter(F.col("size").between(length, 2 * length - 1)), state, length)
        else:
            copies = state.filter((place > F.col("first")) & (F.col("chars") >= min_chars)).select(
                "doc", "pos", (F.col("pos") + length).alias("end"))
        # Written, so that the plan of the result holds no round's joins.
        copies = materialize(copies, "copies")
        found = copies if found is None else found.union(copies)
        in_doc = Window.partitionBy("doc").orderBy("pos").rangeBetween(length, length)
        pairs = (
            state.select("doc", "pos", "rank", F.max("rank").over(in_doc).alias("next"),
                         (F.col("chars") + F.max("chars").over(in_doc)).alias("chars"))
            .filter(F.col("next").isNotNull())
        )
        pairs = materialize(pairs, "pairs")
        repeated = (pairs.groupBy(F.col("rank").alias("head"), "next").agg(F.count("*").alias("n"))
                    .filter("n > 1").select("head", "next"))
        repeated = materialize(repeated, "repeated")
        if repeated.isEmpty():
            return found
        state = (pairs.withColumnRenamed("rank", "head").join(_ranked(repeated, "head", "next"), ["head", "next"])
                 .select("doc", "pos", "chars", "rank"))
        length *= 2


def _copies_of(windows: DataFrame, state: DataFrame, length: int) -> DataFrame:
    """(doc, pos, end) of the ``windows`` (doc, pos, size) that stand earlier; ``state`` has the ranks of ``length`` lines."""
    heads = state.select("doc", "pos", F.col("rank").alias("head"))
    tails = state.select("doc", F.col("pos").alias("back"), F.col("rank").alias("tail"))
    known = materialize(
        windows.withColumn("back", F.col("pos") + F.col("size") - length).join(heads, ["doc", "pos"])
        .join(tails, ["doc", "back"]).select("doc", "pos", "size", "head", "tail"), "known")
    place = F.struct("doc", "pos")
    key = ["size", "head", "tail"]
    repeated = known.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return known.join(repeated, key).filter(place > F.col("first")).select("doc", "pos", (F.col("pos") + F.col("size")).alias("end"))


def deleted_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 min_chars: int = MIN_CHARS, every_length: bool = True) -> DataFrame:
    """(doc, runs): the maximal runs of lines to delete, as (start, end) in order, of each document that has any."""
    copies = later_copies(docs, id_column, text_column, min_chars, every_length)
    furthest = copies.groupBy("doc", "pos").agg(F.max("end").alias("end"))
    in_order = Window.partitionBy("doc").orderBy("pos")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = furthest.withColumn("opens", (F.coalesce(reached, F.lit(-1)) < F.col("pos")).cast("int"))
    runs = (
        opened.withColumn("run", F.sum("opens").over(in_order)).groupBy("doc", "run")
        .agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    )
    return runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def without_later_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                         min_chars: int = MIN_CHARS, every_length: bool = True) -> DataFrame:
    """``docs`` with the later copies of repeated runs of lines cut out of the text.

    A run of any number of lines (cut at \\n; without ``every_length`` of 1, 2, 4, 8, ... lines) is a later copy if the same lines stand together
    earlier: in a document of smaller id (null last; equal ids by the digest of the text), or before
    in the same one. A later copy of at least ``min_chars`` characters, line ends not counted, is deleted; overlapping ones
    make up maximal runs. The other lines are joined again by \\n. Added columns, which replace columns of
    that name: ``n_lines`` (0 for a null text) and ``n_deleted``. A null text stays null, an empty one is one
    line of no characters; rows equal in id and text are one document and get the same result.
    """
    runs = deleted_runs(docs, id_column, text_column, min_chars, every_length)
    key, has = "__document", "__runs"
    joined = (
        docs.withColumn(key, _document(id_column, text_column))
        .join(runs.select(F.col("doc").alias(key), F.col("runs").alias(has)), key, "left")
    )
    lines = F.split(F.col(text_column).cast("string"), "\n")
    cuts = F.col(has)
    # What lies before each run, and behind the last.
    kept = F.transform(cuts, lambda run, i: F.slice(
        lines, F.when(i == 0, 1).otherwise(F.get(cuts, i - 1)["end"] + 1),
        run["start"] - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])))
    tail = F.slice(lines, F.element_at(cuts, -1)["end"] + 1, F.size(lines))
    text = F.when(cuts.isNull(), F.col(text_column)).otherwise(
        F.array_join(F.concat(F.flatten(kept), tail), "\n"))
    n_deleted = F.coalesce(F.aggregate(cuts, F.lit(0), lambda n, run: n + run["end"] - run["start"]), F.lit(0))
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    values = [text.alias(c) if c == text_column else F.col(c) for c in names]
    n_lines = F.when(F.col(text_column).isNull(), 0).otherwise(F.size(lines))
    return joined.select(*values, n_lines.cast("long").alias("n_lines"), n_deleted.cast("long").alias("n_deleted"))
