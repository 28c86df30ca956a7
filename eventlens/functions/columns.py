"""Scalar column operators (flags, guarded ratios, encodings)."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 int; a null comparison gives 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def binary_target(c: str | Column, positive) -> Column:
    """1 where the column equals ``positive``, else 0 (null -> 0)."""
    return flag(_c(c) == F.lit(positive))


def structural_zero(c: str | Column, dtype: str = "int") -> Column:
    """Null means 'none': fill 0 and cast."""
    return F.coalesce(_c(c), F.lit(0)).cast(dtype)


def composite_key(parts: Iterable[str | Column], sep: str = "_", null_safe: bool = False) -> Column:
    """Text key from integer-valued parts, e.g. ``family_no``.

    ``null_safe=False`` makes the key null when any part is null (``concat``);
    ``True`` skips null parts (``concat_ws``).
    """
    cols = [_c(p).cast("bigint").cast("string") for p in parts]
    if null_safe:
        return F.concat_ws(sep, *cols)
    out = cols[0]
    for c in cols[1:]:
        out = F.concat(out, F.lit(sep), c)
    return out


def null_flag(c: str | Column) -> Column:
    return F.isnull(_c(c)).cast("int")


def safe_ratio(num: str | Column, den: str | Column, sentinel: float = -1.0) -> Column:
    """num/den when num >= 0 and den > 0 (sentinels excluded), else ``sentinel``."""
    n, d = _c(num), _c(den)
    return F.when((n >= 0) & (d > 0), n / d).otherwise(F.lit(sentinel))


def utilisation_ratio(num: str | Column, den: str | Column, sentinel: float = -1.0) -> Column:
    """num/den when both are > 0, else ``sentinel``."""
    n, d = _c(num), _c(den)
    return F.when((n > 0) & (d > 0), n / d).otherwise(F.lit(sentinel))


def sentinel_to_null(c: str | Column, sentinel: float = -1.0) -> Column:
    return F.nullif(_c(c), F.lit(sentinel))


def cyclical(c: str | Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2*pi*c/period``."""
    ang = F.lit(2.0 * math.pi) * _c(c) / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


def decade(c: str | Column) -> Column:
    return (F.floor(_c(c) / F.lit(10)) * F.lit(10)).cast("bigint")


def slug(name: str) -> str:
    """Column-name slug: spaces -> ``_``, parentheses dropped, ``/`` -> ``_``."""
    return name.replace(" ", "_").replace("(", "").replace(")", "").replace("/", "_")


def sigmoid(c: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))
