"""Mixing sources to target weights (operator 4).

Every row gets a hash-random key. Inside a source, rows are ordered by that
key; the source's budget of words is spent on whole passes over the source
(epochs) and then on the rows in key order until it is used up exactly. The
cut is found by distributed prefix sums: sums per (source, key range), a
running sum over the ranges, and a row-level running sum only inside the one
range that holds the cut. No task sees a whole source, no text is shuffled.

Defined cases: a null source is a source of its own and comes last in the
order of sources; null sizes count as 0; a source without words has target 0;
rows of equal source, key and id share what is left at the cut evenly
(rounded down); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .prefix import number_rows
from .words import WORD

KEY_BITS = 60
#: Key ranges: at least so many, and one more for each so many rows.
MIN_RANGES, ROWS_PER_RANGE = 256, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_key(id_col: Column) -> Column:
    """The first 60 bits of md5 of the id, any SQL engine has them."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, to the same with
    ``weight`` and ``target``: the total shared by weight, no target above
    ``cap`` times its source, the excess shared again by weight."""
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "_rank", 8)
    by_rank = F.lit(weights[0])
    for i, w in enumerate(weights[1:], 1):
        by_rank = F.when(F.col("_rank") % len(weights) == i, F.lit(w)).otherwise(by_rank)
    s = materialize(ranked.withColumn("weight", by_rank.cast("bigint")).drop("_rank"), "sources")
    limit = F.col("source_size") * F.lit(cap)
    level, full = 0.0, -1
    while True:  # the level only rises, so a source once at its limit stays there
        at_limit = limit < F.lit(level) * F.col("weight")
        row = s.agg(F.sum("source_size").alias("total"),
                    F.coalesce(F.sum(F.when(at_limit, limit)), F.lit(0)).alias("spent"),
                    F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0)).alias("free"),
                    F.count(F.when(at_limit, 1)).alias("full")).first()
        if row["full"] == full or not row["free"] or not row["total"]:
            break
        full, level = row["full"], (row["total"] - row["spent"]) / row["free"]
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return s.withColumn("target", target)


def mix(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``rows`` (id, source, size) to the same with ``source_size``,
    ``target``, ``epochs`` (whole passes over the source) and ``taken``
    (words taken from the row, repeats counted)."""
    base = materialize(rows.select("id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
                                   hash_key(F.col("id")).alias("_key")), "mix-rows")
    return decide(base, cuts(base, weights, cap))


def cuts(base: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: its size, target, epochs and where the last,
    partial pass ends (key, id and what each row there may give)."""
    n = base.count()
    ranges = max(MIN_RANGES, -(-n // ROWS_PER_RANGE))
    width = -(-(1 << KEY_BITS) // ranges)
    ranged = base.withColumn("_range", F.floor(F.col("_key") / F.lit(width)).cast("bigint"))
    per_range = materialize(ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum")), "mix-ranges")
    sizes = per_range.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("bigint")
    targets = materialize(source_targets(sizes, weights, cap).withColumn("_budget", budget).withColumn("epochs", passes)
                          .withColumn("_rest", F.col("_budget") - F.col("epochs") * F.col("source_size")), "mix-targets")
    t = targets.select(F.col("source").alias("_s"), "_rest")
    upto = F.sum("_sum").over(Window.partitionBy("source").orderBy("_range"))  # one row per range
    hit = (per_range.withColumn("_upto", upto).join(t, F.col("source").eqNullSafe(F.col("_s")))
           .where((F.col("_rest") > F.col("_upto") - F.col("_sum")) & (F.col("_rest") <= F.col("_upto")))
           .select("_s", F.col("_range").alias("_r"), (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_left")))
    keyed = (ranged.join(hit, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
             .groupBy("_s", "_left", "_key", "id").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n")))
    run = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_key", F.col("id").asc_nulls_first()))
    cut = (keyed.withColumn("_run", run).where((F.col("_left") > F.col("_run") - F.col("_sum")) & (F.col("_left") <= F.col("_run")))
           .select("_s", F.col("_key").alias("_cut_key"), F.col("id").alias("_cut_id"),
                   F.expr("(_left - _run + _sum) div _n").alias("_give")))
    return materialize(targets.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-cuts")


def decide(base: DataFrame, per_source: DataFrame) -> DataFrame:
    c = per_source.select(F.col("source").alias("_cs"), "source_size", "target", "epochs", "_cut_key", "_cut_id", "_give")
    at = (F.col("_key") == F.col("_cut_key")) & F.col("id").eqNullSafe(F.col("_cut_id"))
    before = (F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & (
        F.col("_cut_id").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("_cut_id")))))
    part = F.when(at, F.least(F.col("size"), F.col("_give"))).when(before, F.col("size")).otherwise(F.lit(0))
    return (base.join(c, F.col("source").eqNullSafe(F.col("_cs")))
            .withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("bigint"))
            .drop("_cs", "_key", "_cut_key", "_cut_id", "_give"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                  weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: a row for each
    pass that takes the document; where the last pass is cut inside a
    document, that row's text ends after the words taken. Documents without
    words follow their source's whole passes."""
    cols = docs.columns
    base = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                   word_count(F.col(text_col)).alias("size"),
                                   hash_key(F.col(id_col)).alias("_key")), "mix-rows")
    per_source = cuts(base, weights, cap)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_doc"), F.col(id_col).alias("id"),
                        F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                        hash_key(F.col(id_col)).alias("_key"))
    d = decide(named, per_source)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    copies = F.col("epochs") + F.when(part > 0, 1).otherwise(0)
    d = d.withColumn("_part", part).withColumn("_copies", copies).where("_copies > 0")
    d = d.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    pieces = F.split(F.col(f"_doc.`{text_col}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut_here = (F.col("_pass") > F.col("epochs")) & (F.col("_part") < F.col("size"))
    text = F.when(cut_here, F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), "")).otherwise(F.col(f"_doc.`{text_col}`"))
    return d.select(*[text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in cols])
