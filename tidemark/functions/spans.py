"""Where the statements of a script stand, as a table function for lateral joins."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE

# Workers get the function by value, so they need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_QUOTED = r"'[^']*+(?:'|\Z)|`[^`]*+(?:`|\Z)"


def _statement(quotes: bool) -> re.Pattern:
    """Group 1 is a statement without its semicolon, or what is left; each match starts where the last one ended."""
    plain = rf"(?:[^;$'`]|{_QUOTED}|\$(?!\$))*+" if quotes else r"(?:[^;$]|\$(?!\$))*+"
    after = rf"(?:[^;'`]|{_QUOTED})*+" if quotes else "[^;]*+"
    return re.compile(rf"(?=[\s\S]);?[{SPACE}]*+({plain}(?:\$\$[\s\S]*?\$\$(?:{after}))?(?=;)|[\s\S]*\Z)")


class _Spans:
    def __init__(self):
        self.patterns = {quotes: _statement(quotes) for quotes in (False, True)}
        self.space = SPACE

    def eval(self, script: str, quotes: bool) -> Iterator[tuple[int, int, int]]:
        at, number = 0, 0
        while script is not None and at < len(script):
            found = self.patterns[quotes].match(script, at)
            at, (first, last) = found.end(), found.span(1)
            if at == len(script):
                if "$$" in found[1]:
                    raise ValueError("closing tag not found")
                last = first + len(found[1].rstrip(self.space))
            if last > first:
                number += 1
                yield number, first + 1, last


_spans = F.udtf(_Spans, returnType="number bigint, first bigint, last bigint")


def statement_spans(df: DataFrame, script: Column | str, quotes: bool = False) -> DataFrame:
    """The columns of ``df`` and a row for each statement: its number from 1, and its first and last code point, from 1.

    The spans cut out the same statements as ``split_statements``: trimmed, without empty ones, ``$$`` bodies
    whole, a body that is not closed fails. With ``quotes`` a semicolon inside ``'...'`` or backticks splits nothing; an open
    quote reaches to the end. Rows without a statement, NULL scripts among them, give no row.
    """
    made = df.withColumn("_script", F.col(script) if isinstance(script, str) else script)
    return made.lateralJoin(_spans(F.col("_script").outer(), F.lit(quotes))).drop("_script")
