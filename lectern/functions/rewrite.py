"""Rewriting of regex matches by column expressions, for what one replacement string can't say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column], group: int = 0) -> Column:
    """``text`` with each match replaced by ``change`` of the match (or of one of its groups)."""
    pieces = F.split(text, pattern, -1)
    matches = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), change), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, matches, lambda p, m: F.concat(p, m)), "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is worked out once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether the text contains one of the phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def trim_ws(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
