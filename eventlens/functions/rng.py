"""Deterministic per-row uniforms.

``uniform`` takes 52 bits of md5 of seed and id, so any SQL engine can repeat
the draw (used where results are checked against an independent SQL oracle)
and draws of different seeds, or of neighbouring ids, have nothing to do with
each other. ``hash_uniform`` (xxhash64) is the Spark-only choice.

``with_permutation`` adds a keyed bijection of 0 .. n - 1, so a row's place in a
shuffle follows from its rank alone, without a sort per shuffle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits used, and how many values they have.
DIGITS = 13
RANGE = float(16**DIGITS)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def uniform(id_col, seed: int | Column = 0) -> Column:
    """``seed`` may be a column (e.g. a repeat number), as in ``uniform_sql``."""
    s = seed if isinstance(seed, Column) else F.lit(int(seed))
    digest = F.md5(F.concat_ws(":", s.cast("bigint").cast("string"), _c(id_col).cast("bigint").cast("string")))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(RANGE)


def uniform_sql(id_sql: str, seed: int | str = 0) -> str:
    """The same draw as DuckDB SQL text (``seed`` may be SQL)."""
    text = f"CAST(CAST({seed} AS BIGINT) AS VARCHAR) || ':' || CAST(CAST({id_sql} AS BIGINT) AS VARCHAR)"
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, {DIGITS}) AS BIGINT) AS DOUBLE) / {RANGE})"


def hash_uniform(*cols, seed: int = 42) -> Column:
    h = F.xxhash64(*[_c(c) for c in cols], F.lit(int(seed)))
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


#: Two primes below 2^31, a multiplier, and what makes a key of each round.
_P1, _P2, _M = 2147483647, 2147483629, 1364004059
_ROUNDS = ((7919, 104729), (6007, 611953), (9973, 224737), (8513, 350377))
_WALK = 64


def _feistel(rank: str, key: str, a, b, div: str) -> str:
    """A permutation of 0 .. a * b - 1 as SQL text: a Feistel network on
    (rank div b, rank mod b) whose round function squares modulo a prime."""
    left, right = f"({rank} {div} {b})", f"({rank} % {b})"
    for i, (x, c) in enumerate(_ROUNDS):
        k = f"({key} * {x} + {c}) % 1073741789"
        if i % 2 == 0:
            left = f"(({left} + (({right} + {k}) * ({right} + {k}) % {_P1} * {_M} % {_P2})) % {a})"
        else:
            right = f"(({right} + (({left} + {k}) * ({left} + {k}) % {_P1} * {_M} % {_P2})) % {b})"
    return f"({left} * {b} + {right})"


def with_permutation(df: DataFrame, rank: str, key: str, n: int, name: str) -> DataFrame:
    """Add ``name``: the place of column ``rank`` (0 .. n - 1) under the
    permutation numbered by column ``key`` (whole numbers up to 2^40). Places
    beyond n - 1, less than one in sqrt(n), walk on along their cycle."""
    a = math.isqrt(max(0, n - 1)) + 1
    b = max(1, -(-n // a))
    on = _feistel("acc", key, a, b, "div")
    walked = F.expr(f"CASE WHEN {name} < {n} THEN {name} ELSE aggregate(sequence(1, {_WALK}), {name}, (acc, i) -> CASE WHEN acc < {n} THEN acc ELSE {on} END) END")
    return df.withColumn(name, F.expr(_feistel(rank, key, a, b, "div"))).withColumn(name, walked)


def permuted(rank: np.ndarray, key: int, n: int, back: bool = False) -> np.ndarray:
    """``with_permutation`` of an array, or the ranks that have these places."""
    a = math.isqrt(max(0, n - 1)) + 1
    b = max(1, -(-n // a))
    rounds = [(i % 2, (key * x + c) % 1073741789) for i, (x, c) in enumerate(_ROUNDS)]

    def step(at: np.ndarray) -> np.ndarray:
        sides, sizes = [at // b, at % b], (a, b)
        for odd, k in reversed(rounds) if back else rounds:
            other = sides[1 - odd] + k
            move = other * other % _P1 * _M % _P2
            sides[odd] = (sides[odd] - move if back else sides[odd] + move) % sizes[odd]
        return sides[0] * b + sides[1]

    out = step(rank.astype(np.int64))
    while (beyond := np.flatnonzero(out >= n)).size:
        out[beyond] = step(out[beyond])
    return out


def permutation_sql(rank: str, key: str, n: str, a: str, b: str) -> str:
    """The same place as DuckDB SQL text; ``a`` is the root of ``n`` rounded
    up, ``b`` is ``n / a`` rounded up."""
    on = _feistel("acc", key, a, b, "//")
    return (f"list_reduce(list_prepend({_feistel(rank, key, a, b, '//')}, range({_WALK})), "
            f"lambda acc, i: CASE WHEN acc < {n} THEN acc ELSE {on} END)")
