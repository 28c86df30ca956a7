"""URL filter by a character language-model ratio (operator 1).

Rules label a part of the URLs as accepted or rejected. From the labelled
URLs two character models are counted, variable-order Markov models with
Witten-Bell smoothing: the probability of a character after its last ``k``
characters is mixed with that after the last ``k - 1``, with more weight on the
shorter context the less often and the more variously the longer one was
seen. A URL's score is the mean over its characters of the log of the
accepted model's probability over the rejected one's. The threshold is
calibrated on labelled URLs that the models have not seen: the score with the
least sum of both error rates there.

All counts are over all distinct URLs and grow with them; they stay in
tables, each distinct window of characters is scored once and joined to the
windows of the URLs. Scores are whole millionths, so no sum depends on the
order of rows.

Defined cases: a null URL and one without ``://`` has empty host and path;
null and empty URLs have no score and the verdict block; a class without
labelled URLs has the uniform model, and without calibration URLs of both
classes the threshold is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Longest context, in characters.
ORDER = 5
#: A character's probability before anything is counted.
UNIFORM = 1 / 256
#: First hex digits of md5 of a labelled URL that is kept for calibration.
CALIBRATION = "0123"
#: Bins of the score's histogram, per unit of log ratio.
BINS = 100
_START = "\x02"
#: Characters of a URL that are cut into windows at a time.
PIECE = 1024

#: host/path and verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (null: none)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, v in sorted(rules, key=lambda r: len(r[0])):
        own, prefix = name.split("/", 1)
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _windows(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character of each URL: the character after its context. A
    long URL is cut into pieces first, so work is linear in its length."""
    text = F.concat(F.lit(_START * ORDER), F.col("url"))
    last = F.floor((F.char_length("url") - 1) / F.lit(PIECE))
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substr(text, (k * PIECE + 1).cast("int"), F.lit(PIECE + ORDER)))
    cut = urls.where(F.char_length("url") > 0).select(*keep, F.explode(pieces).alias("piece"))
    every = F.transform(F.sequence(F.lit(1), F.char_length("piece") - ORDER), lambda i: F.substr(F.col("piece"), i, F.lit(ORDER + 1)))
    return cut.select(*keep, F.explode(every).alias("window"))


def window_scores(urls: DataFrame) -> DataFrame:
    """``urls`` (url, label: 1 accepted, 0 rejected, null) to (window,
    millionths): the log ratio of every window in any of them."""
    one = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0)).alias("a" if v else "r")
    seen = materialize(_windows(urls, "label").groupBy("window").agg(one(1), one(0)), "url-windows")
    lower = None
    for k in range(ORDER + 1):
        gram = F.substr(F.col("window"), F.lit(ORDER + 1 - k), F.lit(k + 1))
        grams = seen.groupBy(gram.alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        grams = grams.withColumn("context", F.substr("gram", F.lit(1), F.lit(k)))
        contexts = grams.groupBy("context").agg(
            F.sum("a").alias("na"), F.count(F.when(F.col("a") > 0, 1)).alias("ta"),
            F.sum("r").alias("nr"), F.count(F.when(F.col("r") > 0, 1)).alias("tr"))
        p = grams.join(contexts, "context")
        if lower is None:
            p = p.withColumns({"la": F.lit(UNIFORM), "lr": F.lit(UNIFORM)})
        else:
            p = p.withColumn("shorter", F.substr("gram", F.lit(2), F.lit(k))).join(lower, "shorter")
        mixed = lambda c: F.when(F.col("n" + c) > 0, (F.col(c) + F.col("t" + c) * F.col("l" + c)) / (F.col("n" + c) + F.col("t" + c))).otherwise(F.col("l" + c))
        p = p.select("gram", mixed("a").alias("la"), mixed("r").alias("lr"))
        lower = p.withColumnRenamed("gram", "shorter")
    ratio = F.log(F.col("la")) - F.log(F.col("lr"))
    return p.select(F.col("gram").alias("window"), F.floor(ratio * 1_000_000 + F.lit(0.5)).cast("bigint").alias("millionths"))


def url_scores(urls: DataFrame) -> DataFrame:
    """``urls`` (uid, url, label, held) to (uid, bin): the mean log ratio of each
    URL's characters in hundredths, rounded down."""
    known = urls.withColumn("label", F.when(~F.col("held"), F.col("label")))
    scores = materialize(window_scores(known), "url-scores")
    summed = _windows(urls, "uid").join(scores, "window").groupBy("uid").agg(F.sum("millionths").alias("s"), F.count(F.lit(1)).alias("n"))
    return summed.select("uid", F.floor(F.col("s") / (F.col("n") * F.lit(1_000_000.0 / BINS))).cast("bigint").alias("bin"))


def threshold(scored: DataFrame) -> int:
    """From (label, bin) of held-out URLs: the least bin to accept."""
    counts = scored.groupBy("label", "bin").count().collect()  # bins are bounded by the models' least probability
    good = {r["bin"]: r["count"] for r in counts if r["label"] == 1}
    bad = {r["bin"]: r["count"] for r in counts if r["label"] == 0}
    if not good or not bad:
        return 0
    n_good, n_bad = sum(good.values()), sum(bad.values())

    def cost(t: int) -> float:
        return sum(n for b, n in good.items() if b < t) / n_good + sum(n for b, n in bad.items() if b >= t) / n_bad

    edges = set(good) | set(bad) | {0}
    return min(edges | {max(edges) + 1}, key=lambda t: (cost(t), abs(t), t))


def judge_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and
    ``score_bin`` (hundredths of the mean log ratio)."""
    url = F.col(f"`{url_col}`")
    urls = pages.select(url.alias("url")).distinct()
    _, verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    label = F.when(verdict == "allow", 1).when(verdict == "block", 0)
    held = F.instr(F.lit(CALIBRATION), F.substring(F.md5("url"), 1, 1)) > 0
    # the rows of a URL's characters carry its md5, not the URL
    labelled = materialize(urls.where("url IS NOT NULL").select(F.md5("url").alias("uid"), "url", label.alias("label"), held.alias("held")), "urls")
    scored = materialize(url_scores(labelled).join(labelled.drop("url"), "uid"), "scored-urls")
    least = threshold(scored.where("held AND label IS NOT NULL"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    new = ("host", "path", "rule", "verdict", "score_bin")
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), F.md5(url).alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = own.join(scored.select(F.col("uid").alias("_u"), F.col("bin").alias("score_bin")), F.col("_url") == F.col("_u"), "left")
    model = F.when(F.col("score_bin") >= least, "allow").otherwise("block")
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in new], "host", "path", rule.alias("rule"),
                        F.coalesce(by_rule, model).alias("verdict"), "score_bin")
