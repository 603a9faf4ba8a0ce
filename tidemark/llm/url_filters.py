"""URL filtering against a dated list, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Width of the time buckets that spread a hot rule, in microseconds: one hour.
BUCKET = 3_600_000_000
#: ``rules`` has the parent domains of two up to this many labels; ``covering`` has all.
LABELS = 4


def host(url: Column) -> Column:
    """Host name of a URL in lower case, without user, port and trailing dot; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def section(url: Column) -> Column:
    """The first part of the path, or an empty text."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def rules(url: Column) -> Column:
    """The nearest list entries that cover a URL: its host, that host's parent domains up to ``LABELS``, and host with section."""
    name = host(url)
    parts = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.lit(LABELS)), lambda n: F.array_join(F.slice(
        parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "."))
    return F.array_compact(F.array_distinct(F.concat(F.array(name, F.concat(name, F.lit("/"), section(url))), parents)))


def covering(url: Column) -> Column:
    """All list entries that cover a URL: its host and every parent domain, alone and with every prefix of the path.

    A prefix is one or more whole parts of the path, without a slash at its end; ``rules`` has the host with a slash for an empty path.
    """
    labels = F.split(host(url), r"\.")
    names = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    path = F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), F.lit("/"))
    parts = F.split(path, "/")
    prefixes = F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    tails = F.concat(F.array(F.lit("")), F.filter(prefixes, lambda p: p != "/"))
    pairs = F.flatten(F.transform(names, lambda name: F.transform(tails, lambda tail: F.concat(name, tail))))
    return F.array_distinct(F.concat(rules(url), F.coalesce(pairs, F.array().cast("array<string>"))))


def validity(changes: DataFrame) -> DataFrame:
    """(rule, category, since, until) from (rule, category, at, seq, listed): when an entry was on the list.

    An entry stands from a change with ``listed`` until the next change of the same rule and category; ``until``
    is null while it still stands. Of several changes at one time the one with the greatest ``seq`` holds. A hot
    entry is cut by time bucket: within a bucket the next change is the next row, and the last one of a
    bucket ends at the first of the next bucket that has any.
    """
    changes = changes.filter(F.col("rule").isNotNull() & F.col("at").isNotNull())
    state = (
        changes.groupBy("rule", "category", "at")
        .agg(F.max_by("listed", F.struct("seq", "listed")).alias("listed"))
        .withColumn("bucket", F.floor(F.col("at") / BUCKET))
    )
    entry = ["rule", "category"]
    starts = state.groupBy(*entry, "bucket").agg(F.min("at").alias("first"))
    following = starts.select(*entry, "bucket", F.lead("first").over(Window.partitionBy(*entry).orderBy("bucket")).alias("beyond"))
    inside = F.lead("at").over(Window.partitionBy(*entry, "bucket").orderBy("at"))
    ended = state.withColumn("next", inside).join(
        following.select(*[F.col(c).alias(f"_{c}") for c in (*entry, "bucket")], "beyond"),
        F.col("rule").eqNullSafe(F.col("_rule")) & F.col("category").eqNullSafe(F.col("_category"))
        & (F.col("bucket") == F.col("_bucket")))
    return ended.filter("listed").select(*entry, F.col("at").alias("since"), F.coalesce("next", "beyond").alias("until"))


def url_decisions(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, url, at, blocked, n_entries, categories) of each capture (id, url, at).

    ``at`` counts microseconds. A capture meets the entries that cover its URL and stood at its time:
    since <= at < until. ``categories`` lists theirs in order, without repetitions or nulls. A capture with a
    null time or without a host meets none. Each row stands for itself, so repeated
    captures give repeated results; other columns are not read, empty tables give no entries.

    The as-of join is an equality on rule and time bucket. An interval is written once per bucket it
    touches, and as at most one interval of an entry leaves a bucket, that adds no more than
    entries times buckets; no bucket beyond the captures' times is written.
    """
    # Written, so that the row numbers stay as they are.
    rows = materialize(captures.select(F.monotonically_increasing_id().alias("row"), "id", "url", "at"), "captures")
    span = rows.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    asked = rows.filter(F.col("at").isNotNull()).select(
        "row", "at", F.floor(F.col("at") / BUCKET).alias("bucket"), F.explode(covering(F.col("url"))).alias("rule"))
    # One row: the captures' first and last time.
    intervals = validity(changes).join(F.broadcast(span)).withColumn("low", F.greatest("since", "low")).withColumn(
        "high", F.least(F.coalesce(F.col("until") - 1, F.col("high")), "high"))
    listed = intervals.filter(F.col("low") <= F.col("high")).select(
        "rule", "category", "since", "until",
        F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.col("high") / BUCKET))).alias("bucket"))
    stands = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    met = (
        asked.join(listed, ["rule", "bucket"]).filter(stands).groupBy("row")
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_set("category")).alias("found"))
    )
    return rows.join(met, "row", "left").select(
        "id", "url", "at", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).alias("n_entries"),
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("categories"))
