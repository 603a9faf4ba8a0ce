"""Versions, script names, target stamps and identifiers as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Name grammar and limits that results have to agree on.
VERSION_PATTERN = r"^(\d{6})_(\d{6})_([a-z][a-z0-9_\-]+)\z"
SCRIPT_PATTERN = r"^(\d{6})_(\d{6})_([a-z][a-z0-9_\-]+)(\.safe)?\.(up|down)\.sql\z"
IDENTIFIER_PATTERN = r"^[A-Za-z0-9_]*\z"
STAMP_LENGTH = 13
FUTURE_HOURS = 8
OPTION_NAME_LIMIT = 256
STORED_NAME_LIMIT = 65000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _judge(name: Column, pattern: str, now: Column | None, parts: Callable[[Column], list[Column]]) -> Column:
    """Struct of ``valid``, ``reason``, ``ts`` and the parts made from the valid name."""
    now = F.current_timestamp() if now is None else now
    latest = (now + F.expr(f"interval {FUTURE_HOURS} hours")).cast("timestamp_ntz")
    stamp = F.concat(F.lit("20"), F.substring(name, 1, 6), F.substring(name, 8, 6))
    matched = F.coalesce(name.rlike(pattern), F.lit(False))
    ts = F.try_to_timestamp(F.when(matched, stamp), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")

    def fields(seen: Column) -> Column:
        reason = (
            F.when(name.isNull() | (name == ""), "empty")
            .when(~seen["matched"], "pattern")
            .when(seen["ts"].isNull(), "calendar")
            .when(seen["ts"] > latest, "future")
        )
        return let(reason, lambda why: F.struct(
            why.isNull().alias("valid"), why.alias("reason"), F.when(why.isNull(), seen["ts"]).alias("ts"),
            *parts(F.when(why.isNull(), name)),
        ))

    return let(F.struct(matched.alias("matched"), ts.alias("ts")), fields)


def parse_version(version: Column | str, now: Column | None = None) -> Column:
    """Struct (valid, reason, ts, name) for ``YYMMDD_hhmmss_name``; century 20, at most 8 hours ahead."""
    return _judge(_col(version), VERSION_PATTERN, now, lambda v: [
        F.substring(v, STAMP_LENGTH + 2, 2**31 - 1).alias("name"),
    ])


def parse_script(file_name: Column | str, now: Column | None = None) -> Column:
    """Struct (valid, reason, ts, version, name, safe, direction) for a script file name."""
    return _judge(_col(file_name), SCRIPT_PATTERN, now, lambda f: [
        F.substring_index(f, ".", 1).alias("version"),
        F.substring(F.substring_index(f, ".", 1), STAMP_LENGTH + 2, 2**31 - 1).alias("name"),
        f.rlike(r"\.safe\.(up|down)\.sql\z").alias("safe"),
        F.substring_index(F.substring_index(f, ".", -2), ".", 1).alias("direction"),
    ])


def version_key(version: Column | str) -> Column:
    """The stamp a version is ordered by: its first 13 characters."""
    return F.substring(_col(version), 1, STAMP_LENGTH)


def normalize_target(target: Column | str, strict: bool = False) -> Column:
    """A stamp, full name, ``yyyy-MM-dd HH:mm:ss`` or 9-10 digit unix second as a stamp.

    Anything else is NULL, or fails the job when ``strict``.
    """
    target = _col(target)
    moment = F.regexp_extract(target, r"^(\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2})([.,]\d+)?\z", 1)
    parsed = F.try_to_timestamp(moment, F.lit("yyyy-MM-dd H:mm:ss"))
    number = F.when(
        F.length(target).between(9, 10) & target.rlike(r"^[+-]?\d+\z"), target.try_cast("bigint")
    )
    as_stamp = "yyMMdd_HHmmss"
    known = F.coalesce(
        F.when(target.rlike(r"^\d{6}_\d{6}(_.+)?\z"), version_key(target)),
        F.date_format(parsed, as_stamp),
        F.date_format(F.timestamp_seconds(number), as_stamp),
    )
    if not strict:
        return known
    return F.coalesce(known, F.raise_error(F.concat(F.lit("no such target format: "), target)))


def is_identifier(name: Column | str, max_length: int = OPTION_NAME_LIMIT) -> Column:
    """Letters, digits and underscore only, at most ``max_length`` bytes; empty is allowed."""
    name = _col(name)
    return name.rlike(IDENTIFIER_PATTERN) & (F.octet_length(name) <= max_length)


def _segments(name: Column) -> Column:
    return F.filter(F.transform(F.split(name, r"\."), lambda p: F.trim(p)), lambda p: p != "")


def _without_catalog(parts: Column, catalog: str) -> Column:
    if not catalog:
        return parts
    leads = F.lower(F.get(parts, F.lit(0))) == catalog.strip().lower()
    return F.when(leads, F.slice(parts, 2, F.size(parts))).otherwise(parts)


def qualify_name(name: Column | str, catalog: str = "") -> Column:
    """Struct (namespace, table, reason) of a dotted name, without a leading catalog segment."""
    name = _col(name)

    def fields(parts: Column) -> Column:
        reason = (
            F.when((name != "") & ~name.rlike("^[A-Za-z_]"), "invalid")
            .when(F.size(parts) == 0, "empty")
            .when(F.size(_without_catalog(parts, catalog)) < 2, "namespace required")
        )
        kept = F.when(reason.isNull(), _without_catalog(parts, catalog))
        return F.struct(
            F.slice(kept, F.lit(1), F.size(kept) - 1).alias("namespace"),
            F.element_at(kept, -1).alias("table"),
            reason.alias("reason"),
        )

    return let(_segments(name), fields)


def qualify_namespace(name: Column | str, catalog: str = "") -> Column:
    """All segments of a dotted namespace without the catalog; NULL when none is left."""
    return let(
        let(_segments(_col(name)), lambda parts: _without_catalog(parts, catalog)),
        lambda kept: F.when(F.size(kept) > 0, kept),
    )


def split_schema_table(name: Column | str, default_schema: str) -> Column:
    """Struct (schema, table, valid): first two segments, or the default schema without a dot."""
    name = _col(name)
    parts = F.split(name, r"\.")
    dotted = F.size(parts) > 1
    schema = F.when(dotted, F.get(parts, F.lit(0))).otherwise(F.lit(default_schema))
    table = F.when(dotted, F.get(parts, F.lit(1))).otherwise(name)
    valid = is_identifier(schema, STORED_NAME_LIMIT) & is_identifier(table, STORED_NAME_LIMIT)
    return F.struct(schema.alias("schema"), table.alias("table"), valid.alias("valid"))


def render_apply_time(apply_time: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_col(apply_time)), "yyyy-MM-dd HH:mm:ss")
