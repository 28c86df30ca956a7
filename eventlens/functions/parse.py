"""Parsing of unit-bearing text and lenient numeric / time parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _to_double(text: Column) -> Column:
    # Empty text (and the literal 'nan' a stringified missing value gives)
    # means missing; anything else must parse (a strict cast raises under
    # ANSI mode, as the reference's astype(float) does).
    t = F.trim(text)
    return F.when((t == "") | (F.lower(t) == "nan"), F.lit(None).cast("double")).otherwise(t.cast("double"))


def parse_currency(c: str | Column) -> Column:
    """``'$1,059.5 million'`` -> 1059.5 (millions)."""
    s = F.regexp_replace(_c(c), r"[$,\s]", "")
    s = F.replace(s, F.lit("million"), F.lit(""))
    return _to_double(s)


def parse_unit(c: str | Column, unit: str) -> Column:
    """``'4,940 kN'`` -> 4940.0; ``'54.9 m'`` -> 54.9."""
    s = F.replace(_c(c), F.lit(unit), F.lit(""))
    s = F.replace(s, F.lit(","), F.lit(""))
    return _to_double(s)


def parse_percent(c: str | Column) -> Column:
    """``'85.7%'`` -> 0.857."""
    return _to_double(F.replace(_c(c), F.lit("%"), F.lit(""))) / F.lit(100.0)


def try_numeric(c: str | Column) -> Column:
    """Text -> double, unparseable -> null."""
    return _try_cast(F.trim(_c(c)), "double")


def _try_cast(col: Column, to: str) -> Column:
    return col.try_cast(to)


def try_long(c: str | Column) -> Column:
    """Text -> nullable long; non-integral numbers truncate, bad -> null."""
    return _try_cast(_try_cast(_c(c), "double"), "bigint")


def try_timestamp(c: str | Column, fmt: str | None = None) -> Column:
    """Text -> timestamp (session time zone), bad -> null."""
    col = _c(c)
    return F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)
