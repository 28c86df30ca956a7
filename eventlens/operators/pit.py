"""Point-in-time ("experience") features per entity.

For every event, using only the entity's strictly earlier events in
(time, tie-break) order:

* ``<p>_prior_launches``   count of earlier events (0 for the first);
* ``<p>_prior_successes``  sum of the binary outcome over them;
* ``<p>_prior_success_rate`` successes / launches, or ``base_rate`` for the
  first event (default: the mean outcome over all rows);
* ``<p>_is_first``         1 for the first event of the entity.

Events with a null entity get nulls (they belong to no entity). Null times
sort last. All of it runs on :func:`running_totals_by_key`, so one hot entity
does not end up in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals_by_key


def global_rate(df: DataFrame, target: str) -> float:
    """Mean of a 0/1 target over all rows (one scalar aggregate)."""
    v = df.agg(F.avg(F.col(target).cast("double")).alias("m")).first()["m"]
    return float(v) if v is not None else 0.0


def prior_experience(
    df: DataFrame,
    entity: str,
    time: str,
    tie: str | Sequence[str],
    target: str,
    prefix: str,
    base_rate: float | None = None,
    first_flag: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    ties = [tie] if isinstance(tie, str) else list(tie)
    if base_rate is None:
        base_rate = global_rate(df, target)
    n_col, s_col = f"{prefix}_prior_launches", f"{prefix}_prior_successes"
    tmp_y = f"_el_y_{prefix}"
    staged = df.withColumn(tmp_y, F.coalesce(F.col(target).cast("bigint"), F.lit(0)))
    out = running_totals_by_key(
        staged,
        [F.col(time).asc_nulls_last()] + [F.col(t).asc_nulls_last() for t in ties],
        [tmp_y],
        entity,
        count_name=n_col,
        prefix="_el_prior_",
        blocks=blocks,
    )
    has_key = F.col(entity).isNotNull()
    n = F.col(n_col)
    s = F.col("_el_prior_" + tmp_y)
    cols = {
        n_col: F.when(has_key, n).cast("bigint"),
        s_col: F.when(has_key, s).cast("bigint"),
        f"{prefix}_prior_success_rate": F.when(has_key, F.when(n == 0, F.lit(float(base_rate)))
                                               .otherwise(s.cast("double") / n)),
    }
    if first_flag:
        cols[f"{prefix}_is_first"] = F.when(has_key, (n == 0).cast("int"))
    return out.withColumns(cols).drop(tmp_y, "_el_prior_" + tmp_y)
