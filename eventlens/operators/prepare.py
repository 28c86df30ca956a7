"""Fit-on-train / apply-to-both preparation for linear models.

sentinel -1 -> null, train-median impute, cyclical sin/cos, standardise
with the *population* standard deviation (zero -> 1). MLlib's ``Imputer``
(approximate median) and ``StandardScaler`` (sample std) differ from this,
so the statistics are taken here: exact medians via the distributed
quantile, means and ``stddev_pop`` in one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import exact_quantiles


@dataclass(frozen=True)
class Prepared:
    continuous: tuple
    binary: tuple
    cyclical: tuple  # ((name, period), ...)
    sentinel: tuple
    median: Mapping[str, float] = field(default_factory=dict)
    mean: Mapping[str, float] = field(default_factory=dict)
    std: Mapping[str, float] = field(default_factory=dict)

    def names(self) -> list[str]:
        out = list(self.continuous) + list(self.binary)
        for c, _ in self.cyclical:
            out += [f"{c}_sin", f"{c}_cos"]
        return out

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        cols = [F.col(k) for k in keep]
        sent = set(self.sentinel)
        for c in self.continuous:
            x = F.col(c).cast("double")
            if c in sent:
                x = F.nullif(x, F.lit(-1.0))
            x = F.coalesce(x, F.lit(self.median.get(c)))
            cols.append(((x - F.lit(self.mean[c])) / F.lit(self.std[c])).alias(c))
        for c in self.binary:
            cols.append(F.col(c).cast("double").alias(c))
        for c, p in self.cyclical:
            ang = F.lit(2.0 * math.pi) * F.col(c).cast("double") / F.lit(float(p))
            cols += [F.sin(ang).alias(f"{c}_sin"), F.cos(ang).alias(f"{c}_cos")]
        return df.select(*cols)


def fit_prepare(train: DataFrame, continuous: Sequence[str], binary: Sequence[str] = (),
                cyclical: Mapping[str, float] | None = None, sentinel: Sequence[str] = ()) -> Prepared:
    cyclical = dict(cyclical or {})
    sent = set(sentinel)
    base = train.select(*[
        (F.nullif(F.col(c).cast("double"), F.lit(-1.0)) if c in sent else F.col(c).cast("double")).alias(c)
        for c in continuous])
    med = {c: v[0] for c, v in exact_quantiles(base, list(continuous), [0.5]).items()} if continuous else {}
    imputed = base.select(*[F.coalesce(F.col(c), F.lit(med[c])).alias(c) for c in continuous])
    mean, std = {}, {}
    if continuous:
        row = imputed.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(continuous)],
                          *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(continuous)]).first()
        for i, c in enumerate(continuous):
            mean[c] = float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0
            sd = row[f"s{i}"]
            std[c] = float(sd) if sd not in (None, 0.0) and not math.isnan(sd) else 1.0
    return Prepared(tuple(continuous), tuple(binary), tuple(cyclical.items()), tuple(sentinel), med, mean, std)
