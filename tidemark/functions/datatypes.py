"""Column types from their written form, and which type changes keep every value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column metadata that keeps a written type Spark has no type for.
WRITTEN_TYPE = "written_type"

# Written types that Spark spells differently or stores as another type.
# A time is kept as microseconds of the day, a uuid as its 36 characters.
_SPELLING = (
    (r"\blist\s*<", "array<"),
    (r"\bdecimal\b(?!\s*\()", "decimal(38,0)"),
    (r"\bdecimal\s*\(\s*(\d+)\s*\)", r"decimal(\1,0)"),
    (r"\btime\b(?!\s*:)", "bigint"),
    (r"\buuid\b(?!\s*:)", "string"),
    (r"\blong\b(?!\s*:)", "bigint"),
)

# The type names a table may use.
TYPE_NAMES = frozenset(
    "boolean int integer long bigint float double decimal date time timestamp timestamp_ntz "
    "string uuid binary struct array list map".split()
)


def spark_type(text: str) -> T.DataType:
    """The Spark type of a written column type, e.g. ``map<string, list<decimal(9,2)>>``."""
    lowered = text.strip().lower()
    if re.search(r"\bnot\s+null\b", lowered):
        raise ValueError(f"columns are always nullable: {text}")
    # Names come before a colon or, in a struct, stand alone after a comma or bracket.
    for word in re.findall(r"[a-z_]\w*(?!\w)(?!\s*:)", lowered):
        if word not in TYPE_NAMES:
            raise ValueError(f"unknown type {word} in {text}")
    fixed = text.strip()
    for pattern, spelling in _SPELLING:
        fixed = re.sub(pattern, spelling, fixed, flags=re.IGNORECASE)
    return T.DataType.fromDDL(fixed)


_DECIMAL = r"^decimal\((\d+),(\d+)\)\z"


def written_type(text: Column | str) -> Column:
    """One spelling per type: small letters, no blanks, ``int`` and ``bigint``."""
    text = F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"\s+", "")
    for pattern, spelling in ((r"\binteger\b(?!:)", "int"), (r"\blong\b(?!:)", "bigint")):
        text = F.regexp_replace(text, pattern, spelling)
    return text


def type_change(old: Column | str, new: Column | str) -> Column:
    """``same``, ``widen`` or ``refuse`` for a change between two written types.

    Case, blanks and synonyms do not matter. Spark alone is no guard: some narrowing reads fail
    late, others silently succeed.
    """
    old, new = map(written_type, (old, new))

    def digits(c: Column, group: int) -> Column:
        return F.regexp_extract(c, _DECIMAL, group).try_cast("int")

    wider = (digits(old, 2) == digits(new, 2)) & (digits(new, 1) > digits(old, 1))
    return (
        F.when(old == new, "same")
        .when((old == "int") & (new == "bigint"), "widen")
        .when((old == "float") & (new == "double"), "widen")
        .when(F.coalesce(wider, F.lit(False)), "widen")
        .otherwise("refuse")
    )


def is_widening(old: T.DataType, new: T.DataType) -> bool:
    """The same rule for two types at hand."""
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return old.scale == new.scale and new.precision >= old.precision
    return old == new or (old, new) in (
        (T.IntegerType(), T.LongType()), (T.FloatType(), T.DoubleType())
    )
