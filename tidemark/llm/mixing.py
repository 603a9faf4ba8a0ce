"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .columns import WORD, word_count

MOST = 3
LEVELS = 5
DIGITS = 3


def document_hash(id_column: Column, text_column: Column) -> Column:
    """15 hex digits that order the documents of a source: of the id, or of the text where that is null."""
    return F.substring(F.md5(F.coalesce(id_column.cast("string"), text_column, F.lit(""))), 1, LEVELS * DIGITS)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. They share the sum of all
    sizes by weight; a target stops at three times its source's size and the excess is shared
    again by weight among the others, until none is above. An empty source has target 0.

    The level that the open sources share is found from running sums over the sources in the order
    in which they would stop; the two windows hold one row per source, never documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(named) - 1) % 3 + 1)
    stops = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    stopped = F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))
    rest = F.sum("source_size").over(everything) - stopped
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.select("source", "source_size", "weight", rest.alias("rest"), open_weight.alias("open_weight"))
    # The first source that would not stop sets the level for itself and all behind it.
    fits = F.col("rest") * F.col("weight") <= MOST * F.col("source_size") * F.col("open_weight")
    first = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source",
                                        "rest", "open_weight"))).over(everything)
    chosen = level.withColumn("first", first)
    shared = F.col("weight") * F.col("first.rest") / F.col("first.open_weight")
    cap = (MOST * F.col("source_size")).cast("double")
    return chosen.select("source", "source_size", F.when(F.col("first").isNull(), cap)
                         .otherwise(F.least(cap, shared)).alias("target"))


def thresholds(units: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, last): the highest document hash that a source's budget takes; no row where it takes none.

    ``units`` is (source, hash, size), ``budgets`` (source, budget) with a non-null, unique source key.
    Sizes are summed by source and leading hash digits. The buckets that fit lie below the
    boundary bucket, which alone is cut by the next digits, until all digits are used; the last
    bucket, one document, is taken if that comes nearer to the budget.
    """
    edge = budgets.select("source", F.lit("").alias("prefix"), F.col("budget").alias("left"))
    held = units
    for level in range(1, LEVELS + 1):
        digits = level * DIGITS
        held = held.join(edge.select("source", F.col("prefix").alias("at")), "source").filter(
            F.startswith("hash", "at")).drop("at")
        buckets = (
            held.groupBy("source", F.substring("hash", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"))
            .join(edge.select("source", "left"), "source")
        )
        up_to = Window.partitionBy("source").orderBy("prefix")
        running = buckets.withColumn("taken", F.sum("size").over(up_to))
        # The boundary bucket is the first that does not fit; if all fit, there is none.
        edge = materialize(
            running.filter(F.col("taken") > F.col("left")).groupBy("source")
            .agg(F.min_by(F.struct("prefix", (F.col("left") - F.col("taken") + F.col("size")).alias("left"), "size"),
                          "prefix").alias("edge"))
            .select("source", "edge.prefix", "edge.left", "edge.size"), "edge")
    half = F.col("left") >= F.col("size") / 2
    return edge.select("source", F.col("prefix").alias("last"), half.alias("takes_last"))


def _source_key(source_column: str) -> Column:
    """The source as a key that is never null: a null source and one named like its stand-in stay apart."""
    source = F.col(source_column)
    return F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source.cast("string"), F.lit("")))


def _copies(document: Column, of: str = "") -> Column:
    """How often a document with this hash is taken, beside its source's row of the plan."""
    last = F.col(f"{of}last")
    more = (document < last) | ((document == last) & F.col(f"{of}takes_last"))
    return F.col(f"{of}copies") + F.when((F.col(f"{of}budget") > 0) & F.coalesce(more, F.lit(False)), 1).otherwise(0)


def _plan(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all documents, and per source its target, whole copies, budget and last hash."""
    units = materialize(docs.select(
        F.col(id_column).alias("id"), _source_key(source_column).alias("source"),
        document_hash(F.col(id_column), F.col(text_column)).alias("hash"),
        word_count(F.col(text_column)).alias("size")), "sizes")
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sizes.select(F.when(F.col("source") != "n", F.substr("source", F.lit(2))).alias("source"), "source_size")
    aims = targets(named).select(_source_key("source").alias("source"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = materialize(aims.withColumn("copies", whole).withColumn(
        "budget", F.col("target") - F.col("copies") * F.col("source_size")), "targets")
    last = thresholds(units.select("source", "hash", "size"), aims.filter("budget > 0").select("source", "budget"))
    return units, materialize(aims.join(last, "source", "left"), "plan")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of each row of ``docs``.

    Every document of a source is taken as many whole times as its target covers the source; what
    remains of the target is a budget that takes documents in hash order once more, up to the hash
    where it is used up. So no document is taken more than three times, and rerunning gives the
    same mix. Rows with one id (or, without an id, one text) share a hash and go together. A null source is a
    source of its own; a null or wordless text has size 0. Other columns are not read.
    """
    units, plan = _plan(docs, id_column, text_column, source_column)
    return units.join(plan, "source").select(
        "id", "size", "source_size", "target", (F.col("size") * _copies(F.col("hash"))).cast("long").alias("taken"))


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             source_column: str = "source") -> DataFrame:
    """Each row of ``docs`` as many times as ``mix`` takes it, in its own columns; rows without words go."""
    plan = _plan(docs, id_column, text_column, source_column)[1]
    inner = docs.withColumns({
        "__source": _source_key(source_column),
        "__hash": document_hash(F.col(id_column), F.col(text_column)),
    })
    taken = inner.join(plan.select(F.col("source").alias("__source"), F.struct("copies", "budget", "last", "takes_last").alias("__plan")),
                       "__source")
    times = F.when(F.rlike(F.col(text_column), F.lit(WORD)), _copies(F.col("__hash"), "__plan.")).otherwise(0)
    return (taken.withColumn("__times", times).filter("__times > 0")
            .withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns))
