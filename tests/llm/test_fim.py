"""Fill-in-the-middle against plain Python, and the round trip."""

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import HARD_TEXTS, SF0001, documents, long_text  # noqa: F401
from pyspark.sql import functions as F

from eventlens.llm import fim
from eventlens.llm.queries import QUERIES

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text, seed=1, rewritten=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rewritten:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [*HARD_TEXTS, "<P>", "a<S>b", "x <M", "<", "<P", "P>", "<<S", "S>M>", "\x00a\x00", "a\nb", "ABC", "\n", "é", "😀a😀", "<M><P>"]


def test_against_plain_python(spark, long_text):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(20 * len(TEXTS))] + [(None, "null id <"), (None, None), (5, "again"), (5, "again"), (9000, long_text), (9001, "é" * 100_000), (-4, long_text[:999])]
    df = documents(spark, rows, ["n", "output", "_row"])
    got = fim.fill_in_middle(df).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "_row", *fim.NEW, "back"]
    have = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()), key=repr)
    assert have == sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    texts = sorted(t or "" for _, t in rows)
    assert sorted(r.back for r in got.collect()) == texts
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}


def test_rates_and_seed(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut, in the middle").alias("text"))
    forms = {r.form: r["count"] for r in fim.fill_in_middle(df, seed=7, rewritten=50, spm=10).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 150 and abs(forms["spm"] - 200) < 60
    rows = [(r.doc_id, r.output) for r in fim.fill_in_middle(df, seed=7, rewritten=50, spm=10).where("doc_id < 50").collect()]
    assert rows == [(i, brute(i, "some words to cut, in the middle", 7, 50, 10)[4]) for i, _ in rows]
    assert fim.fill_in_middle(documents(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z<PSM>\n\x00é😀\x1c-")), max_size=6))
def test_units(texts):
    assert fim.split_units(pa.array(texts, pa.string())).to_pylist() == [UNIT.findall(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("a<PSM> é")), min_size=1, max_size=6), st.integers(0, 1 << 40))
def test_transform(texts, seed):
    made = fim.transform(pa.array(texts, pa.string()), list(range(len(texts))), seed, 90, 20)
    assert list(zip(*[made[c].to_pylist() for c in fim.NEW])) == [brute(i, t, seed) for i, t in enumerate(texts)]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in QUERIES["op13_fill_in_middle"](spark, SF0001).collect():
        n, form, a, b, out = brute(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(docs[r.doc_id]))


assert pytest
