"""Model explanations as Spark jobs.

* permutation importance: every (feature, repeat) evaluation is a slice of
  ONE exploded frame that is scored in one ``transform`` and reduced with
  one grouped confusion aggregate; rows are ranked once, and a column shuffle
  is a keyed bijection of the ranks, so only the permuted values travel;
* directional probe: rows x (feature, up/down) as a generator, one scoring
  pass, grouped means;
* linear Shapley ``coef * (x - mean)``;
* sampling Shapley (Strumbelj & Kononenko 2014) for any scorer: rows x
  permutations x prefixes exploded and scored once; per permutation the
  contributions telescope, so they sum exactly to f(x) - f(background row).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sigmoid
from ..functions.rng import hash_uniform, permuted
from ..operators.metrics import cells_to_metrics, cum_confusion, auc_ap
from ..operators.prefix import global_rank
from ..operators.joins import broadcast_small
from ..operators.reshape import importance_pivot
from ..operators.schema_ops import select_by_variance
from ..session import materialize


# --- scorers defined by a formula (used for oracle-checked explanations) -----

class LinearLogistic:
    """p = sigmoid(intercept + sum coef_j * x_j) as a Column expression."""

    def __init__(self, coef: Mapping[str, float], intercept: float = 0.0, name: str = "linear"):
        self.coef, self.intercept, self.name = dict(coef), float(intercept), name

    def score(self, df: DataFrame) -> DataFrame:
        z = F.lit(self.intercept)
        for f, c in self.coef.items():
            z = z + F.lit(float(c)) * F.col(f)
        return df.withColumn("p", sigmoid(z))


# --- linear Shapley -----------------------------------------------------------

def linear_shapley(df: DataFrame, coef: Mapping[str, float], id_col: str) -> DataFrame:
    """Long (id, feature, value, shap) with shap = coef * (x - mean(x))."""
    feats = list(coef)
    means = df.agg(*[F.avg(f).alias(f) for f in feats]).first()
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                             (F.lit(float(coef[f])) * (F.col(f) - F.lit(means[f]))).alias("shap")) for f in feats])
    return df.select(id_col, F.explode(arr).alias("s")).select(id_col, "s.feature", "s.value", "s.shap")


def shap_report(long: DataFrame, models: Sequence[str], model_col: str = "model") -> DataFrame:
    """Mean |shap| per feature, one column per model, plus the row mean."""
    return importance_pivot(long.withColumn("_abs", F.abs("shap")), "feature", model_col, "_abs", models)


def case_contributions(long: DataFrame, cases: DataFrame, id_col: str, n: int = 15, model_col: str = "model") -> DataFrame:
    """The ``n`` largest contributions by size of every listed case and
    model, with their ``rank`` (ties by feature). A window partition is one
    case: at most as many rows as features."""
    w = Window.partitionBy(model_col, id_col).orderBy(F.abs("shap").desc(), "feature")
    found = long.join(cases.select(id_col).distinct(), id_col, "left_semi")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_features(long: DataFrame, n: int = 15, model_col: str = "model", across: str = "all models") -> DataFrame:
    """(model, rank, feature, importance): the ``n`` features of largest mean
    |shap| per model, and by the mean over the models."""
    per = long.groupBy(model_col, "feature").agg(F.avg(F.abs("shap")).alias("importance"))
    both = per.unionByName(per.groupBy("feature").agg(F.avg("importance").alias("importance")).withColumn(model_col, F.lit(across)))
    w = Window.partitionBy(model_col).orderBy(F.col("importance").desc(), "feature")  # one row per feature
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --- permutation importance ---------------------------------------------------

#: Rows of a block of ranks: a task holds as many, and a value of each for every feature and repeat.
PERMUTED_ROWS = 1 << 16
#: Scores of one (range, group) that are put in order at a time.
AUC_ROWS = 250_000


def permuted_frame(df: DataFrame, features: Sequence[str], id_col: str, repeats: int, seed: int = 42) -> DataFrame:
    """Rows x (feature, repeat): all columns as in ``df`` except ``feature``,
    which holds the value of the row at the permuted position."""
    names, columns = list(features), df.columns
    shapes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {'double' if c in names else shapes[c]}" for c in columns] + ["`repeat` int", "_j int"])

    def exploded(rows: pa.Table, permutations: Iterator[tuple]) -> pa.Table:
        parts = []
        for j, k, values in permutations:
            moved = {c: values if c == names[j] else rows.column(c) for c in columns}
            parts.append(pa.table({**moved, "repeat": pa.array(np.full(len(values), k), pa.int32()), "_j": pa.array(np.full(len(values), j), pa.int32())}))
        return pa.concat_tables(parts)

    made = permuted_blocks(df, names, id_col, repeats, seed, exploded, schema)
    return made.select(*columns, "repeat", F.element_at(F.array(*[F.lit(f) for f in names]), F.col("_j") + 1).alias("feature"))


def permuted_blocks(df: DataFrame, features: Sequence[str], id_col: str, repeats: int, seed: int, emit, schema: str) -> DataFrame:
    """``emit(rows, permutations)`` of every block of rows: a table of the
    block and (number of the feature, repeat, its permuted values), in turn.

    Row rank r(i) is the rank by id, made once; the permutation of feature j
    and repeat k is the bijection of the ranks numbered by
    ``permutation_seed``, and row i takes the feature's value from the row at
    the place of r(i). Nothing is ranked or written per feature and repeat.

    Ranks lie in blocks. Both the block that gives a value and the one that
    takes it know the bijection, so between two blocks only the values travel,
    in the order of the takers' ranks: 8 bytes a row, feature and repeat, and
    no key. A task holds a block and the values sent to it.
    """
    ranked = materialize(global_rank(df, [F.col(id_col)], "_r"), "ranked")
    n = ranked.count()
    size = max(1, min(PERMUTED_ROWS, math.ceil(n / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    blocks, names, width = max(1, math.ceil(n / size)), list(features), len(features)
    keys = [(j, k, permutation_seed(j, k, seed)) for j in range(width) for k in range(repeats)]
    block = F.expr(f"CAST(_r div {size} AS INT)").alias("block")

    def give(table: pa.Table) -> Iterator[pa.Table]:
        table = table.sort_by("_r")
        place, source = table.column("_r").to_numpy(), table.column("block")[0].as_py()
        values = [table.column(f).combine_chunks() for f in names]
        for j, k, key in keys:
            taker = permuted(place, key, n, back=True)
            order = np.argsort(taker, kind="stable")
            ends = np.searchsorted(taker[order], np.arange(1, blocks + 1) * size)
            sent = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values[j].take(pa.array(order)))
            there = np.flatnonzero(np.diff(np.r_[0, ends]))
            yield pa.table({"block": pa.array(there, pa.int32()), "j": pa.array(np.full(len(there), j), pa.int32()), "k": pa.array(np.full(len(there), k), pa.int32()),
                            "source": pa.array(np.full(len(there), source), pa.int32()), "sent": sent.take(pa.array(there))})

    kept = [c for c in df.columns if c not in names]

    def take(rows: pa.Table, sent: pa.Table) -> pa.Table:
        rows = rows.sort_by("_r")
        place = rows.column("_r").to_numpy()
        j, k, source = (sent.column(c).to_numpy() for c in ("j", "k", "source"))
        order = np.lexsort((source, k, j))
        values = sent.column("sent").combine_chunks().take(pa.array(order)).flatten()

        def permutations() -> Iterator[tuple]:
            for at, (j, k, key) in enumerate(keys):  # each sends every row of the block one value
                by_source = np.argsort(permuted(place, key, n) // size, kind="stable")
                back = np.empty(len(place), np.int64)
                back[by_source] = np.arange(at * len(place), (at + 1) * len(place))
                yield j, k, values.take(pa.array(back))

        return emit(rows, permutations())

    own = ranked.select(block, "_r", *kept, *[F.col(f).cast("double").alias(f) for f in names])
    givers = own.select("block", "_r", *names).repartition(blocks, "block").groupBy("block")
    sent = givers.applyInArrow(lambda t: pa.concat_tables(list(give(t))), "block int, j int, k int, source int, sent array<double>")
    # one exchange of whole blocks, a task a block
    return own.repartition(blocks, "block").groupBy("block").cogroup(sent.repartition(blocks, "block").groupBy("block")).applyInArrow(take, schema)


def permutation_seed(feature_index, repeat, seed: int):
    """The seed of one permutation (columns or SQL numbers)."""
    return repeat + feature_index * 1_000_003 + seed


def _metric(scored: DataFrame, y: str, metric: str, threshold: float, group_cols: Sequence[str]) -> DataFrame:
    if metric in ("f1", "precision", "recall", "accuracy", "f2", "mcc"):
        pred = (F.col("p") >= F.lit(threshold)).cast("int")
        yc = F.col(y)
        cells = scored.groupBy(*group_cols).agg(
            F.count_if((yc == 1) & (pred == 1)).alias("TP"), F.count_if((yc == 0) & (pred == 1)).alias("FP"),
            F.count_if((yc == 0) & (pred == 0)).alias("TN"), F.count_if((yc == 1) & (pred == 0)).alias("FN"))
        return cells_to_metrics(cells).select(*group_cols, F.col(metric).alias("metric"))
    if metric == "auc_roc":
        return auc_ap(cum_confusion(scored, y, "p", group_cols), group_cols).select(
            *group_cols, F.col("auc_roc").alias("metric"))
    raise ValueError(f"unknown metric {metric}")


def grouped_auc(scored: DataFrame, y: str, edges: Sequence[float], features: Sequence[str]) -> DataFrame:
    """(feature, repeat, metric): the exact ROC-AUC of every group of rows.

    Scores are dealt by ``edges`` (ascending, any: they decide the balance,
    not the result). A batch sends a (range of scores, group) its distinct
    scores and their counts; such a part is put in order where it is gathered,
    and adds what its negatives lie below, within it and, by the counts of the
    higher ranges, beyond."""
    cuts = np.unique(np.array(edges, float))
    src = scored.where(F.col("p").isNotNull() & F.col(y).isNotNull()).select(
        F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("bigint").alias("j"), F.col("repeat").cast("bigint").alias("repeat"),
        F.col("p").cast("double").alias("p"), F.col(y).cast("bigint").alias("y"))

    def tally(p: np.ndarray, tp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        distinct, of = np.unique(p, return_inverse=True)
        return distinct, *(np.bincount(of, w, len(distinct)).astype(np.int64) for w in (tp, n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            j, repeat, p, label = (b.column(i).to_numpy() for i in range(4))
            group = j << 32 | repeat
            for g in np.unique(group):
                here = group == g
                score, tp, n = tally(p[here], label[here], np.ones(int(here.sum())))
                bucket = np.searchsorted(cuts, score, "right")
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = pa.array(np.r_[first, len(score)], pa.int32())
                yield pa.record_batch({"bucket": pa.array(bucket[first], pa.int32()), "j": pa.array(np.full(len(first), g >> 32), pa.int32()), "repeat": pa.array(np.full(len(first), g & 0xFFFFFFFF), pa.int32()),
                                       "p": pa.ListArray.from_arrays(ends, pa.array(score)), "tp": pa.ListArray.from_arrays(ends, pa.array(tp, pa.int32())), "n": pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))})

    def area(table: pa.Table) -> pa.Table:
        _, tp, n = tally(*(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("p", "tp", "n")))
        tp, fp = tp[::-1], (n - tp)[::-1]  # from the highest score down
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("bucket", "j", "repeat")}, "P": pa.array([int(tp.sum())]), "N": pa.array([int(fp.sum())]),
                         "area": pa.array([float((fp * (np.cumsum(tp) - tp / 2.0)).sum())])})

    dealt = src.mapInArrow(deal, "bucket int, j int, repeat int, p array<double>, tp array<int>, n array<int>")
    parts = dealt.groupBy("bucket", "j", "repeat").applyInArrow(area, "bucket int, j int, repeat int, P long, N long, area double")
    above = Window.partitionBy("j", "repeat").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a range of scores
    placed = parts.withColumn("_above", F.coalesce(F.sum("P").over(above), F.lit(0)))
    total = placed.groupBy("j", "repeat").agg(F.sum("P").alias("P"), F.sum("N").alias("N"), F.sum(F.col("area") + F.col("N").cast("double") * F.col("_above")).alias("area"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("area") / F.col("P").cast("double") / F.col("N").cast("double"))
    return total.select(F.element_at(F.array(*[F.lit(f) for f in features]), F.col("j")).alias("feature"), "repeat", auc.alias("metric"))


def permutation_drops(scorer, df: DataFrame, features: Sequence[str], y: str, id_col: str, repeats: int = 30,
                      metric: str = "f1", threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """(feature, repeat, drop) with drop = metric(original) - metric(permuted).
    Only the id, the label and the features are carried."""
    df = df.select(id_col, y, *features)
    base = _metric(scorer.score(df), y, metric, threshold, []).first()["metric"]
    cells = scorer.permuted_cells(df, features, y, id_col, repeats, seed, threshold) if metric != "auc_roc" and hasattr(scorer, "permuted_cells") else None
    if cells is not None:
        m = materialize(cells_to_metrics(cells).select("feature", "repeat", F.col(metric).alias("metric")), "permuted-metric")
        return m.select("feature", "repeat", (F.lit(float(base)) - F.col("metric")).alias("drop"))
    perm = permuted_frame(df, features, id_col, repeats, seed)
    if metric == "auc_roc":  # the unpermuted scores say where to cut
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / AUC_ROWS))
        probs = [i / parts for i in range(1, parts)] or [0.5]
        edges = scorer.score(df).agg(F.percentile_approx("p", F.array(*[F.lit(q) for q in probs]), F.lit(10_000))).first()[0] or []
        m = grouped_auc(scorer.score(perm), y, edges, features)
    else:
        m = _metric(scorer.score(perm), y, metric, threshold, ["feature", "repeat"])
    m = materialize(m, "permuted-metric")  # a row a feature and repeat
    return m.select("feature", "repeat", (F.lit(float(base)) - F.col("metric")).alias("drop"))


def importance_ci(drops: DataFrame, sqrt_n: bool = True, digits: int | None = 4) -> DataFrame:
    """mean_drop, std_drop (population), CI = mean +/- 1.96 * std (/ sqrt(n)
    when ``sqrt_n``), significant = ci_lower > 0; rounded like the report."""
    g = drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"),
                                     F.count("drop").alias("_n"))
    half = F.lit(1.96) * F.col("std_drop") / (F.sqrt(F.col("_n")) if sqrt_n else F.lit(1.0))
    out = g.select("feature", "mean_drop", "std_drop", (F.col("mean_drop") - half).alias("ci_lower"),
                   (F.col("mean_drop") + half).alias("ci_upper"))
    out = out.withColumn("significant", (F.col("ci_lower") > 0).cast("int"))
    if digits is not None:
        out = out.select("feature", *[F.round(c, digits).alias(c) for c in ("mean_drop", "std_drop", "ci_lower",
                                                                              "ci_upper")], "significant")
    return out


def permutation_importance(scorer, df, features, y, id_col, repeats=30, metric="f1", threshold=0.5, seed=42,
                           sqrt_n=True) -> DataFrame:
    return importance_ci(permutation_drops(scorer, df, features, y, id_col, repeats, metric, threshold, seed), sqrt_n)


# --- directional sensitivity -----------------------------------------------------

def directional_probe(scorer, df: DataFrame, features: Sequence[str], binary: Sequence[str] = ()) -> DataFrame:
    """Mean change of P(1) in percentage points when each feature moves up /
    down one population SD (binary features: set to 1 / set to 0).
    Returns (feature, up_pp, down_pp)."""
    sds = df.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    base = scorer.score(df).select(F.avg("p")).first()[0]
    moves = []
    for f in features:
        if f in binary:
            up, down = F.lit(1.0), F.lit(0.0)
        else:
            sd = float(sds[f] or 0.0)
            up, down = F.col(f) + F.lit(sd), F.col(f) - F.lit(sd)
        moves += [F.struct(F.lit(f).alias("feature"), F.lit("up").alias("dir"), up.cast("double").alias("v")),
                  F.struct(F.lit(f).alias("feature"), F.lit("down").alias("dir"), down.cast("double").alias("v"))]
    ex = df.select(*df.columns, F.explode(F.array(*moves)).alias("m"))
    ex = ex.select(*[F.when(F.col("m.feature") == f, F.col("m.v")).otherwise(F.col(f).cast("double")).alias(f)
                     if f in features else F.col(f) for f in df.columns],
                   F.col("m.feature").alias("feature"), F.col("m.dir").alias("dir"))
    means = scorer.score(ex).groupBy("feature").agg(
        F.avg(F.when(F.col("dir") == "up", F.col("p"))).alias("_up"),
        F.avg(F.when(F.col("dir") == "down", F.col("p"))).alias("_down"))
    return means.select("feature", ((F.col("_up") - F.lit(base)) * 100).alias("up_pp"),
                        ((F.col("_down") - F.lit(base)) * 100).alias("down_pp"))


# --- sampling Shapley -------------------------------------------------------------

def background_sample(df: DataFrame, id_col: str, n: int = 500, seed: int = 42, uniform=None) -> DataFrame:
    """Up to ``n`` rows with the smallest seeded uniform (a sampling
    operator: the limit is the feature). Adds ``bg_idx`` 0..n-1."""
    u = uniform(F.col(id_col), seed) if uniform else hash_uniform(id_col, seed=seed)
    ranked = df.withColumn("_u", u)
    top = ranked.orderBy("_u", id_col).limit(n)
    w = Window.orderBy("_u", id_col)  # at most n rows
    return top.withColumn("bg_idx", (F.row_number().over(w) - 1).cast("int")).drop("_u")


def sampling_shapley(scorer, rows: DataFrame, background: DataFrame, features: Sequence[str], id_col: str,
                     n_perm: int = 8, seed: int = 42) -> DataFrame:
    """Per (row, feature): mean over ``n_perm`` random feature orders of the
    score change when the feature switches from the background row's value
    to the row's value, after its predecessors in that order.

    Also returns per-row ``f_x`` and ``f_bg`` (mean background score over the
    permutations) so that sum(shap) = f_x - f_bg holds exactly.
    Output: (id, feature, value, shap, f_x, f_bg).
    """
    k = len(features)
    n_bg = background.count()
    bg = background.select(F.col("bg_idx"), *[F.col(f).cast("double").alias(f"_z_{f}") for f in features])
    base = rows.select(id_col, *[F.col(f).cast("double").alias(f) for f in features])
    perm = base.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    perm = perm.withColumn("bg_idx", F.pmod(F.xxhash64(F.col(id_col), F.col("perm"), F.lit(seed)),
                                            F.lit(n_bg)).cast("int"))
    perm = perm.join(broadcast_small(bg), "bg_idx")
    hs = [hash_uniform(F.col(id_col), F.col("perm"), F.lit(j), seed=seed) for j in range(k)]
    pos = []
    for j in range(k):
        cnt = F.lit(0)
        for i in range(k):
            if i != j:
                cnt = cnt + ((hs[i] < hs[j]) | ((hs[i] == hs[j]) & F.lit(i < j))).cast("int")
        pos.append(cnt)
    perm = perm.select(id_col, "perm", *features, *[f"_z_{f}" for f in features],
                       *[p.alias(f"_pos{j}") for j, p in enumerate(pos)])
    steps = perm.withColumn("L", F.explode(F.sequence(F.lit(0), F.lit(k))))
    vec = steps.select(id_col, "perm", "L",
                       *[F.when(F.col(f"_pos{j}") < F.col("L"), F.col(f)).otherwise(F.col(f"_z_{f}")).alias(f)
                         for j, f in enumerate(features)],
                       # the feature switched on at step L (position L-1)
                       F.coalesce(*[F.when(F.col(f"_pos{j}") == F.col("L") - 1, F.lit(f)) for j, f in
                                    enumerate(features)], F.lit(None).cast("string")).alias("feature"),
                       F.coalesce(*[F.when(F.col(f"_pos{j}") == F.col("L") - 1, F.col(f)) for j, f in enumerate(features)]).alias("value"))
    scored = scorer.score(vec).select(id_col, "perm", "L", "feature", "value", "p")
    w = Window.partitionBy(id_col, "perm").orderBy("L")  # k + 1 rows per group
    diffs = scored.withColumn("d", F.col("p") - F.lag("p").over(w)).withColumn(
        "f_bg", F.first("p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) \
        .withColumn("f_x", F.last("p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    contrib = diffs.where(F.col("L") > 0)
    return contrib.groupBy(id_col, "feature").agg(
        F.first("value").alias("value"), (F.sum("d") / F.lit(n_perm)).alias("shap"), F.first("f_x").alias("f_x"), F.avg("f_bg").alias("f_bg"))


# --- everything about fitted models -------------------------------------------------

def explain_models(models: Mapping[str, tuple], test: DataFrame, background: DataFrame, features: Sequence[str], y: str, id_col: str,
                   requested: Sequence[str] = (), top: int = 20, dependence: int = 10, cases: int = 5, repeats: int = 30, seed: int = 42) -> DataFrame:
    """One long table (model, kind, id, rank, feature, value, number) on the
    Shapley values of every row of ``test``, written once per model:

    * ``shap_mean_abs``: mean size per feature, ranked;
    * ``dependence``: the features to look at, requested ones first, then by
      importance, with at least three different values;
    * ``case``: the contributions of the first ``cases`` failures (label 0, by
      id), ranked by size, with the feature's value;
    * ``perm_drop``, ``perm_low``, ``perm_high``: permutation importance (F1)
      and its interval.

    ``models``: name to (scorer, shapley), where ``shapley(rows, background)``
    gives (id, feature, value, shap)."""
    failures = test.where(F.col(y) == 0).orderBy(id_col).limit(cases).select(id_col)  # a report of a few cases
    none = F.lit(None)
    parts = []

    def rows(df: DataFrame, kind: str, number: str, case=none, rank=none, value=none) -> DataFrame:
        return df.select(F.lit(name).alias("model"), F.lit(kind).alias("kind"), case.cast("bigint").alias("id"), rank.cast("int").alias("rank"), "feature",
                         value.cast("double").alias("value"), F.col(number).cast("double").alias("number"))

    for name, (scorer, shapley) in models.items():
        long = materialize(shapley(test, background).select(F.lit(name).alias("model"), id_col, "feature", "value", "shap"), "shap")
        ranked = materialize(top_features(long, top).where(F.col("model") == name), "shap-top")
        parts += [rows(ranked, "shap_mean_abs", "importance", rank=F.col("rank")),
                  rows(select_by_variance(test, ranked.select("feature", "importance"), requested, dependence).join(ranked.select("feature", "importance"), "feature"),
                       "dependence", "importance", rank=F.col("position") + 1),
                  rows(case_contributions(long, failures, id_col, top), "case", "shap", F.col(id_col), F.col("rank"), F.col("value"))]
        perm = materialize(permutation_importance(scorer, test, features, y, id_col, repeats, seed=seed), "perm")
        parts += [rows(perm, kind, column) for kind, column in (("perm_drop", "mean_drop"), ("perm_low", "ci_lower"), ("perm_high", "ci_upper"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
