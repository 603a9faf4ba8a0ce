"""Multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Distance in code points up to which parts belong to one scope.
REACH = 200

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("id", "key", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS

# Fixed by the contract: the three base patterns. A short run of hex digits or capitals ends where
# the character class ends, so the least lengths may stand in those two patterns themselves.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

# Weak parts: alone they are ordinary text.
IDENTIFIER = r"""(?i:user|username|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
KEY = r"[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"""(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+"""


def _matches(text: Column, kind: str, pattern: str, holds: Column | None = None, group: bool = False) -> Column:
    """(kind, nth, gap, size, holds) of each match: its length and that of the text between it and the last one."""
    arrays = [F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))]
    if group:
        arrays.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    zipped = F.arrays_zip(*arrays)

    def one(at: Column, nth: Column) -> Column:
        match = at["1"]
        good = holds(at) if holds else F.lit(True)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), nth.alias("nth"), F.length(at["0"]).alias("gap"),
                        F.length(match).alias("size"), good.alias("holds"))

    found = F.filter(F.transform(zipped, one), lambda m: m["size"].isNotNull())
    return F.when(F.rlike(text, F.lit(pattern)), found)


def candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, id, parts): a number for each row of ``docs`` and all its matches, written to the shared folder."""
    text = F.col("text")
    mixed = lambda at: F.rlike(at["1"], F.lit("[0-9]")) & F.rlike(at["1"], F.lit("[A-Z]")) & F.rlike(at["1"], F.lit("[a-z]"))
    kinds = [
        _matches(text, "assign", ASSIGN, lambda at: F.length(at["2"]) >= ASSIGN_LENGTH, group=True),
        _matches(text, "access", ACCESS), _matches(text, "hex", HEX), _matches(text, "id", IDENTIFIER),
        _matches(text, "key", KEY, mixed), _matches(text, "endpoint", ENDPOINT),
    ]
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,holds:boolean>>")
    found = F.concat(*[F.coalesce(k.cast("array<struct<kind:int,nth:int,gap:int,size:int,holds:boolean>>"), none) for k in kinds])
    # Once written, the row numbers stay as they are.
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", found.alias("parts")), "parts")


def spans(parts: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all base spans, and of the weak ones whose complements are near.

    Two spans share a scope if they do not overlap and at most ``REACH`` code points lie between them, so no value
    completes itself; lines, blocks or objects are no scopes. A weak identifier
    needs a secret near it (assign, hex or key), a weak key an access identifier (access or id), an endpoint
    both. A key that touches a base span or an identifier is part of that one and not a span of its own. Near
    partners are found as the last span before and the first one after, per row in order of
    position: an interval join that grows with the number of spans and emits no pairs.
    """
    in_kind = Window.partitionBy("row", "kind").orderBy("nth")
    moved = parts.select("row", F.explode("parts").alias("p")).select("row", "p.*").withColumn(
        "end", F.sum(F.col("gap").cast("long") + F.col("size")).over(in_kind))
    placed = moved.filter("holds").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")

    by_place = Window.partitionBy("row").orderBy("start")
    so_far, later = by_place.rangeBetween(Window.unboundedPreceding, 0), by_place.rangeBetween(1, Window.unboundedFollowing)
    kind = F.col("kind")

    number = KINDS.index
    base = kind < len(BASE_KINDS)
    owner = base | (kind == number("id"))
    covered = F.max(F.when(owner, F.col("end"))).over(so_far) > F.col("start")
    followed = F.min(F.when(owner, F.col("start"))).over(later) < F.col("end")
    inside = (kind == number("key")) & (F.coalesce(covered, F.lit(False)) | F.coalesce(followed, F.lit(False)))
    touched = placed.withColumn("inside", inside).filter(~F.col("inside"))

    # Both ends of each span as points: the last end up to its start, and the first start from its end on, are its neighbours.
    points = touched.withColumn("closes", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "at", F.when(F.col("closes"), F.col("end")).otherwise(F.col("start")))
    by_point = Window.partitionBy("row").orderBy("at")
    closed, opening = by_point.rangeBetween(Window.unboundedPreceding, 0), by_point.rangeBetween(0, Window.unboundedFollowing)

    def near(test: Column) -> Column:
        back = F.col("at") - F.max(F.when(test & F.col("closes"), F.col("at"))).over(closed)
        ahead = F.min(F.when(test & ~F.col("closes"), F.col("at"))).over(opening) - F.col("at")
        return F.coalesce(F.when(F.col("closes"), ahead).otherwise(back) <= REACH, F.lit(False))

    identifier = kind.isin(number("access"), number("id"))
    secret = kind.isin(number("assign"), number("hex"), number("key"))
    judged = (
        points.withColumn("by_identifier", near(identifier)).withColumn("by_secret", near(secret))
        .groupBy("row", "kind", "start", "end").agg(*[F.max(c).alias(c) for c in ("by_identifier", "by_secret")])
    )
    linked = (
        base | ((kind == number("id")) & F.col("by_secret")) | ((kind == number("key")) & F.col("by_identifier"))
        | ((kind == number("endpoint")) & F.col("by_identifier") & F.col("by_secret"))
    )
    return judged.filter(linked).select("row", "kind", "start", "end")


def secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans) of each row of ``docs``: spans as (start, kind number, kind, end), in that order.

    Positions count code points from 0, the end is exclusive. Whole texts are read; a null text is
    empty and has no spans. Each row stands for itself, so repeated rows give repeated
    results. Other columns are not read.
    """
    parts = candidates(docs, id_column, text_column)
    names = F.array(*map(F.lit, KINDS))
    found = (
        spans(parts.filter(F.size("parts") > 0)).groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", F.get(names, F.col("kind")).alias("name"), "end")))
             .alias("spans"))
    )
    rows = parts.select("row", "id").join(found, "row", "left")
    empty = F.array().cast(found.schema["spans"].dataType)
    return rows.select("id", F.coalesce("spans", empty).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
