"""Statement texts, secrets and connection strings as column functions."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Mask, secret parameters and placeholders, in the order they are applied.
MASK = "****"
SECRET_PARAMETERS = ("token", "credential", "s3.secret-access-key", "s3.session-token", "password")
PLACEHOLDERS = ("cluster", "placeholder_custom", "username", "password")

#: Bound of the pattern that a plan carries.
MANY_CHARS = 4_000_000

# Fixed value: white space that is trimmed from both ends of a text.
SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Group 1 is a statement without its semicolon, or what is left at the end of the text. A $$ body
# may hold semicolons. Each match starts where the last one ended, and the possessive parts keep
# the matching linear on long texts.
_STATEMENT = (
    r"\G(?=[\s\S]);?(?U:\s*+)"
    r"([^;$]*+(?:\$(?!\$)[^;$]*+)*+(?:\$\$[\s\S]*?\$\$[^;]*+)?(?=;)|[\s\S]*\z)"
)

# Group 1 is quoted text, which stays; every other branch is a comment.
_COMMENT_OR_QUOTED = (
    r"('[^']*+(?:''[^']*+)*+(?:'|\z)|`[^`]*+(?:`|\z))"
    r"|--[^\n]*+"
    r"|/\*[\s\S]*?(?:\*/|\z)"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_statements(text: Column | str) -> Column:
    """Array of the statements of a script, trimmed, without empty ones.

    ``$$ ... $$`` bodies stay whole; a body that is not closed, or not followed by a
    semicolon, fails the job.
    """
    def with_last(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        checked = F.when(last.contains("$$"), F.raise_error(F.lit("closing tag not found"))).otherwise(
            F.rtrim(last, F.lit(SPACE))
        )
        closed = F.slice(parts, F.lit(1), F.size(parts) - 1)
        return F.when(F.size(parts) == 0, parts).otherwise(
            F.filter(F.array_append(closed, checked), lambda p: p != "")
        )

    return let(F.regexp_extract_all(_col(text), F.lit(_STATEMENT), F.lit(1)), with_last)


def strip_comments(text: Column | str) -> Column:
    """Remove ``--`` and ``/* */`` comments outside quotes and backticks; line ends stay."""
    return F.regexp_replace(_col(text), _COMMENT_OR_QUOTED, "$1")


def fill_template(text: Column | str, values: Mapping[str, Column | str]) -> Column:
    """Replace ``{name}`` placeholders one after the other, so a value may hold a later placeholder.

    Values may be plain strings or columns, for instance joined per row.
    """
    unknown = set(values) - set(PLACEHOLDERS)
    if unknown:
        raise ValueError(f"unknown placeholders: {sorted(unknown)}")
    result = _col(text)
    for name in PLACEHOLDERS:
        if name in values:
            value = values[name]
            value = F.lit(value) if isinstance(value, str) else value
            result = F.replace(result, F.lit("{%s}" % name), value)
    return result


def mask_literals(text: Column | str, secrets: Sequence[Column | str]) -> Column:
    """Replace every occurrence of each secret, in the given order; empty secrets are skipped."""
    result = _col(text)
    for secret in secrets:
        value = F.lit(secret) if isinstance(secret, str) else secret
        # Replacing an empty text changes nothing.
        result = F.replace(result, F.coalesce(value, F.lit("")), F.lit(MASK))
    return result


def mask_literal_array(text: Column | str, secrets: Column | str) -> Column:
    """As :func:`mask_literals` for an array column of secrets."""
    return F.aggregate(
        _col(secrets), _col(text), lambda acc, s: F.replace(acc, F.coalesce(s, F.lit("")), F.lit(MASK))
    )


def _written(text: str) -> str:
    """``text`` as a literal of a pattern."""
    return "".join(c if c.isascii() and c.isalnum() else r"\x{%X}" % ord(c) for c in text)


def _choice(branches: Sequence[tuple[str, str]]) -> str:
    """One of several patterns with different first characters, in order; many are halved by a look ahead."""
    if len(branches) <= 4:
        return "|".join(pattern for _, pattern in branches)
    half = len(branches) // 2
    first, last = _written(branches[0][0]), _written(branches[half - 1][0])
    return f"(?=[{first}-{last}])(?:{_choice(branches[:half])})|{_choice(branches[half:])}"


def _trie(texts: Sequence[str]) -> str:
    """Pattern of sorted different texts as a trie: every branch goes on as far as it can, so the longest one wins."""
    shared = os.path.commonprefix([texts[0], texts[-1]])
    rest = [t[len(shared):] for t in texts if len(t) > len(shared)]
    if not rest:
        return _written(shared)
    branches = [(first, _trie(list(group))) for first, group in groupby(rest, key=lambda t: t[0])]
    return f"{_written(shared)}(?:{_choice(branches)}){'?' if len(rest) < len(texts) else ''}"


def mask_many(text: Column | str, secrets: Sequence[str]) -> Column:
    """Replace every secret of a long list in one pass over the text, however many there are.

    At each place the longest secret that begins there is masked, and the search goes on behind it. So where
    occurrences of two secrets overlap, the one that begins first is masked whole, and of those that begin
    at one place the longest; what is left of the other stays. Masks are not searched again. Where none overlap, the
    result is that of :func:`mask_literals`. Empty secrets are skipped, repeated ones count once, a NULL text stays NULL.

    The secrets become one pattern in the plan, which every task compiles once: a trie whose branches are
    found by halving, so a place costs a few steps and not one per secret. They are a list of the
    caller, at most ``MANY_CHARS`` characters in all; a longer one is an error.
    """
    kept = sorted({s for s in secrets if s})
    if not kept:
        return _col(text)
    if sum(map(len, kept)) > MANY_CHARS:
        raise ValueError(f"more than {MANY_CHARS} characters of secrets")
    return F.regexp_replace(_col(text), F.lit(_trie(kept)), F.lit(MASK))


def mask_url(url: Column | str) -> Column:
    """Mask the password of ``user:password@`` and the values of secret parameters."""
    url = _col(url)
    result = F.regexp_replace(url, r"^((?>[\s\S]*?://)[^@:]*:)[^@]+@", "$1" + MASK.replace("$", r"\$") + "@")
    for name in SECRET_PARAMETERS:
        key = name.replace(".", r"\.")
        result = F.regexp_replace(result, rf"({key}=)[^&# ]*", f"$1{MASK}")
    return result


def shorten(text: Column | str, n: int) -> Column:
    """Cut to ``n`` characters plus ``...``; zero or less means no limit."""
    text = _col(text)
    if n <= 0:
        return text
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


# Groups: driver, user, password, hosts, database, options. The first mark of each kind counts.
_CONNECTION = (
    r"^((?>[\s\S]*?(?=://)))://(?:([^@:]*)(?::([^@]*))?@)?([^/?]*)(?:/([^?]*))?(?:\?([\s\S]*))?\z"
)


def parse_connection(url: Column | str) -> Column:
    """Struct (driver, username, password, hosts, database, options) of a connection string.

    ``hosts`` is an array of (address, host, port); ``options`` maps each key to its values.
    NULL when there is no driver, no host or an option that cannot be decoded.
    """
    url = _col(url)

    def part(group: int) -> Column:
        return F.regexp_extract(url, _CONNECTION, group)

    def host(address: Column) -> Column:
        return F.struct(
            address.alias("address"), F.substring_index(address, ":", 1).alias("host"),
            F.regexp_extract(address, r"^[^:]*:([\s\S]*)\z", 1).alias("port"),
        )

    def option(pair: Column) -> Column:
        value = F.regexp_extract(pair, r"^[^=]*=([\s\S]*)\z", 1)
        return F.struct(
            F.try_url_decode(F.substring_index(pair, "=", 1)).alias("key"), F.try_url_decode(value).alias("value")
        )

    def by_key(pairs: Column) -> Column:
        return let(F.array_distinct(pairs["key"]), lambda keys: F.map_from_arrays(keys, F.transform(
            keys, lambda k: F.filter(pairs, lambda p: p["key"] == k)["value"])))

    addresses = F.filter(F.transform(F.split(part(4), ","), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(F.filter(F.split(part(6), "&"), lambda p: p != ""), option)

    def fields(lists: Column) -> Column:
        readable = ~part(6).contains(";") & F.forall(
            lists["pairs"], lambda p: p["key"].isNotNull() & p["value"].isNotNull()
        )
        return F.when((F.size(lists["hosts"]) > 0) & readable, F.struct(
            part(1).alias("driver"), part(2).alias("username"), part(3).alias("password"),
            lists["hosts"].alias("hosts"), part(5).alias("database"), by_key(lists["pairs"]).alias("options"),
        ))

    return F.when(url.contains("://"), let(
        F.struct(F.transform(addresses, host).alias("hosts"), pairs.alias("pairs")), fields))


def is_cluster(connection: Column | str) -> Column:
    return F.size(_col(connection)["hosts"]) > 1


def has_credentials(connection: Column | str) -> Column:
    c = _col(connection)
    return (c["username"] != "") | (c["password"] != "")


def normal_form(text: Column | str) -> Column:
    """Text with white space folded, and none around commas and inside parentheses."""
    folded = F.regexp_replace(F.btrim(_col(text), F.lit(SPACE)), "[\t\n\f\r ]+", " ")
    for loose, tight in ((" , ", ","), (", ", ","), (" )", ")"), ("( ", "(")):
        folded = F.replace(folded, F.lit(loose), F.lit(tight))
    return folded


_NAME = r"(?:`[^`]*`|[A-Za-z0-9_.`]+)"

# The kinds of table change, with the words that open each statement.
STATEMENT_KINDS = (
    ("create_namespace", r"^CREATE\s+NAMESPACE\b"),
    ("drop_namespace", r"^DROP\s+NAMESPACE\b"),
    ("create_table", r"^CREATE\s+TABLE\b"),
    ("drop_table", r"^DROP\s+TABLE\b"),
    ("rename_table", r"^RENAME\s+TABLE\b"),
    ("add_column", rf"^ALTER\s+TABLE\s+{_NAME}\s+ADD\s+COLUMN\b"),
    ("add_partition_field", rf"^ALTER\s+TABLE\s+{_NAME}\s+ADD\s+PARTITION\s+FIELD\b"),
    ("drop_column", rf"^ALTER\s+TABLE\s+{_NAME}\s+DROP\s+COLUMN\b"),
    ("drop_partition_field", rf"^ALTER\s+TABLE\s+{_NAME}\s+DROP\s+PARTITION\s+FIELD\b"),
    ("rename_column", rf"^ALTER\s+TABLE\s+{_NAME}\s+RENAME\s+COLUMN\b"),
    ("alter_column_type", rf"^ALTER\s+TABLE\s+{_NAME}\s+ALTER\s+COLUMN\b"),
    ("set_sort_order", rf"^ALTER\s+TABLE\s+{_NAME}\s+WRITE\s+(?:ORDERED\s+BY|UNORDERED)\b"),
)


def classify_statement(statement: Column | str) -> Column:
    """Struct (kind, conditional): one of 12 kinds or ``unsupported``, and the IF [NOT] EXISTS flag."""
    def fields(body: Column) -> Column:
        kind = F.lit("unsupported")
        for name, pattern in reversed(STATEMENT_KINDS):
            kind = F.when(body.rlike("(?i)" + pattern), name).otherwise(kind)
        conditional = body.rlike(
            r"(?i)^(?:CREATE\s+(?:NAMESPACE|TABLE)\s+IF\s+NOT\s+EXISTS|DROP\s+(?:NAMESPACE|TABLE)\s+IF\s+EXISTS)\b"
        )
        return F.struct(kind.alias("kind"), conditional.alias("conditional"))

    return let(F.regexp_replace(strip_comments(statement), r"^\s+|[\s;]+\z", ""), fields)
