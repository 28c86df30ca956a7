r"""Chat formatting with a grammar round trip (operator 6). DataFrame
functions only.

Template of a turn: ``### Role: text</turn>`` and a line feed. The parser
reads it back without looking ahead: a turn ends at the first ``</turn>``,
its role ends at the first ``: ``, and ``\x`` stands for ``x``. A turn is
first rendered as it is and parsed; if what comes back differs from the
source, it is rendered again at the next level of escaping until the two are
identical:

* level 0: nothing is escaped;
* level 1: each backslash is doubled;
* level 2: also the marks inside a text or role are broken by a backslash:
  ``<\/turn>``, ``#\## `` and, in a role, ``:\ ``. No mark is left, so this level always
  round-trips.

``###`` at the start of content is no danger to this parser, but it would
look like a turn to a reader, so it counts as a conflict too. After the turns
are joined, the whole conversation is parsed again and compared, which
``round_trip`` reports.

Defined cases: null text and null role are empty; a null conversation id is a
conversation of its own; turns are ordered by (turn, role, text), nulls first,
so repeated rows stay and ties have one order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
MARK = "### "
LEVELS = 3


def escape(text: Column, level: int, role: bool = False) -> Column:
    if level >= 1:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if level >= 2:
        text = F.replace(text, F.lit(END), F.lit("<\\/turn>"))
        text = F.replace(text, F.lit(MARK), F.lit("#\\## "))
        if role:
            text = F.replace(text, F.lit(": "), F.lit(":\\ "))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(MARK), escape(role, level, True), F.lit(": "), escape(text, level), F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """An array of (role, text) from rendered text."""
    turns = F.split(formatted, r"</turn>\n?", -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def one(t: Column) -> Column:
        colon = F.instr(t, ": ")
        head = F.substring(t, F.lit(len(MARK) + 1), colon - F.lit(len(MARK) + 1))
        return F.struct(unescape(head).alias("role"), unescape(F.substr(t, colon + 2)).alias("text"))

    return F.transform(turns, one)


def _same(role: Column, text: Column, level: int) -> Column:
    """Whether the turn, rendered at this level, is parsed back as itself and
    shows a reader no second mark."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    shown = F.contains(escape(text, level), F.lit(MARK)) | F.contains(escape(role, level, True), F.lit(MARK))
    return (parse(render(role, text, level)) == source) & ~shown


def _at(level: Column, f) -> Column:
    """``f(k)`` where the level is ``k``."""
    out = f(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(level == k, f(k)).otherwise(out)
    return out


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn with ``rendered``, ``level`` and, by position in the
    conversation, ``ordinal`` and the span of the escaped text in the
    formatted conversation (``start``, ``length``, in code points)."""
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(_same(F.col("role"), F.col("text"), k), F.lit(k)).otherwise(level)
    t = t.withColumn("level", level)
    t = t.withColumn("rendered", _at(F.col("level"), lambda k: render(F.col("role"), F.col("text"), k)))
    t = t.withColumn("length", F.char_length(_at(F.col("level"), lambda k: escape(F.col("text"), k))).cast("bigint"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.char_length("rendered").cast("bigint")
    upto = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (t.withColumn("ordinal", F.row_number().over(w))
            .withColumn("start", upto - F.col("length") - F.lit(len(END) + 1)))


def format_conversations(turns: DataFrame, trained_role: str = "assistant", **columns: str) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans``
    (start and length in ``formatted``, in code points, of each text to train
    on), ``parsed`` (the turns read back) and ``round_trip`` (whether they
    equal the source). A conversation is one output row, so it is what one
    task has to hold."""
    t = format_turns(turns, **columns)
    item = F.struct("ordinal", "rendered", "role", "text", "start", "length")
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("_turns"))
    g = g.withColumn("formatted", F.array_join(F.transform("_turns", lambda x: x["rendered"]), ""))
    g = g.withColumn("parsed", parse(F.col("formatted")))
    source = F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    spans = F.transform(F.filter("_turns", lambda x: x["role"] == trained_role), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return g.select("conv_id", "formatted", spans.alias("loss_spans"), "parsed", (F.col("parsed") == source).alias("round_trip"))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped text under each span."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
