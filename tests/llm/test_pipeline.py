"""Mixing and quality against plain Python, and the pipeline stage by stage."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import HARD_TEXTS, SF0001, documents, long_text  # noqa: F401
from test_ngram_join import brute
from test_tokens import check_pieces, whole

import corpus_pipeline as cp
from eventlens.llm import mix, quality
from eventlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(rows, weights=(5, 2, 1), cap=3):
    """(id, source, size) with unique ids to {id: (source_size, target, taken)}."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    out = {}
    for s in names:
        budget = int(np.floor(target.get(s, 0.0) + 0.5))
        passes, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        key = lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest()[:15], r[0])
        for i, _, n in sorted((r for r in rows if r[1] == s), key=key):
            part = min(n, rest)
            rest -= part
            out[i] = (sizes[s], target.get(s, 0.0), passes * n + part)
    return out


@pytest.mark.parametrize("sources", [["a", "b", "c", None, "d"], ["hot"] * 9 + ["x", "y"], ["one"]])
def test_mix(spark, sources):
    rows = [(i, sources[i * i % len(sources)], (i * 37) % 101 if i % 9 else 0) for i in range(900)]
    got = {r.id: (r.source_size, pytest.approx(r.target), r.taken) for r in mix.mix(spark.createDataFrame(rows, "id bigint, source string, size bigint")).collect()}
    want = mixed(rows)
    assert got == want
    assert all(t <= 3 * n for (_, _, t), (_, _, n) in zip((want[i] for i, _, _ in rows), rows))


def test_mix_hard_cases(spark):
    schema = "id bigint, source string, size bigint"
    assert mix.mix(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mix.mix(spark.createDataFrame([(1, "a", 0), (2, None, None)], schema)).collect()] == [0, 0]
    rows = [(None, "a", 5), (None, "a", 5), (7, "a", 3), (7, "a", 3), (8, "b", 900), (9, None, 2)]
    got = mix.mix(spark.createDataFrame(rows, schema)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    target = {r.source: r.target for r in got}
    assert all(target[s] - 2 <= taken[s] <= target[s] + 0.5 for s in taken)


def test_mixed_corpus(spark, long_text):
    texts = HARD_TEXTS + [long_text[: 500 * i] for i in range(40)] + [long_text]
    rows = [(i, t, ["a", "b", None, "c"][i % 4]) for i, t in enumerate(texts)]
    got = mix.mix_documents(documents(spark, rows, ["size", "epochs", "id"])).collect()
    want = mixed([(i, s, len(WORD.findall(t or ""))) for i, t, s in rows])
    words, full = Counter(), {i: t for i, t, _ in rows}
    for r in got:
        words[r.doc_id] += len(WORD.findall(r.text or ""))
        assert r.text == full[r.doc_id] or full[r.doc_id].startswith(r.text)
    assert {i: n for i, n in words.items() if n} == {i: t for i, (_, _, t) in want.items() if t}
    assert mix.mix_documents(documents(spark, [])).count() == 0


def counts(text):
    w = WORD.findall(text or "")
    seen, dup, full = set(), 0, 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            full, dup = full + 1, dup + (line in seen)
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeat = len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)})
    t = text or ""
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup, "n_lines": full,
            "n_repeat_words": repeat, "n_upper": len(re.findall("[A-Z]", t)), "n_letters": len(re.findall("[A-Za-z]", t)), "n_stutter": sum(a == b for a, b in zip(w, w[1:]))}


def keeps(text):
    c = counts(text)
    return not any(bool(r.rejects(*[np.array([c[k]]) for k in r.counts])[0]) for r in quality.RULES)


def test_quality_hard_texts(spark, long_text):
    texts = HARD_TEXTS + [long_text, "a\nb\na\n\n \n" * 30, "HELLO THERE " * 30, "so so so so " * 30, "x # y $ " * 20, "\n".join(f"line {i} of it" for i in range(40))]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    df = quality.judge(documents(spark, list(enumerate(texts)), ["kept", "n_words", "_row"]), counts=names)
    for r in df.collect():
        c = counts(texts[r.doc_id])
        assert {k: r[k] for k in names} == {k: c[k] for k in names}
        assert r.kept == keeps(texts[r.doc_id]) == (r.failed_rule is None)
    assert quality.judge(documents(spark, [])).count() == 0
    assert sorted(r.doc_id for r in quality.keep_good(documents(spark, list(enumerate(texts)))).collect()) == [i for i, t in enumerate(texts) if keeps(t)]


def test_cascade_stops_early():
    import pyarrow as pa
    batch = quality.Batch(pa.array(["few", "word " * 50]))
    failed, made = quality.cascade(batch, quality.RULES)
    assert failed.tolist() == [0, 1] and made["n_repeat_words"].tolist() == [-1, 50]
    assert set(made) == {"n_words", "n_repeat_words"}


def read(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    columns, rows, stages = docs.columns, {r.doc_id: r for r in docs.collect()}, dict(cp.STAGES)
    out = read(spark, stages["quality_rules"](spark, docs, SF0001), str(tmp_path / "1"))
    kept = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(kept) == {i for i, r in rows.items() if keeps(r.text)} and all(kept[i] == rows[i] for i in kept)
    out = read(spark, stages["near_duplicates"](spark, out, SF0001), str(tmp_path / "2"))
    one = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(one) == {d for d, _, c in brute([(i, r.text) for i, r in kept.items()]) if d == c} and all(one[i] == rows[i] for i in one)
    out = read(spark, stages["pseudonyms"](spark, out, SF0001), str(tmp_path / "3"))
    private = {r.doc_id: r for r in out.collect()}
    alone = {r.doc_id: r.text for r in QUERIES["op10_feistel_pseudonyms"](spark, SF0001).collect()}
    assert out.columns == columns and {i: r.text for i, r in private.items()} == {i: alone[i] for i in one}
    out = read(spark, stages["source_mix"](spark, out, SF0001), str(tmp_path / "4"))
    want = mixed([(i, r.source, len(WORD.findall(r.text))) for i, r in private.items()])
    got, n = out.collect(), Counter()
    for r in got:
        n[r.doc_id] += len(WORD.findall(r.text))
        assert private[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
    assert out.columns == columns and n == Counter({i: t for i, (_, _, t) in want.items() if t})
    pieces = stages["packed"](spark, out, SF0001).collect()
    ids = whole("byte_bpe_50k.json", [r.text for r in got])
    assert Counter() == Counter(r.doc_id for r in got) - Counter(p.doc_id for p in pieces if p.start == 0)
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids)
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for ps in by.values():
        ps.sort()
        assert [o for o, _ in ps] == [sum(k for _, k in ps[:i]) for i in range(len(ps))] and sum(k for _, k in ps) <= 1024
    assert sum(p.length for p in pieces) > 0.93 * 1024 * len(by)


def test_run(spark):
    assert cp.run(spark, SF0001).count() > 0


def test_stages_on_hard_rows(spark, long_text):
    rows = [(None, long_text), (None, None), (3, long_text), (3, long_text), (4, ""), (5, long_text[:3000], None)]
    for rows in (rows, []):
        df = documents(spark, rows, ["kept", "target"])
        for name, stage in cp.STAGES:
            out = stage(spark, df, "")
            assert name == "packed" or out.columns == df.columns
            assert out.count() >= (1 if rows else 0)


@pytest.mark.parametrize("rows,left", [
    ([(7, "a b c d e f"), (7, "z y x w v u"), (5, "z y x w v u")], [(5, "z y x w v u"), (7, "a b c d e f")]),
    ([(7, "same text of a few words"), (7, "same text of a few words"), (None, "same text of a few words")], [(7, "same text of a few words")]),
    ([(None, "k l m n o p")] * 3 + [(4, ""), (4, ""), (None, None)], [(4, ""), (4, ""), (None, None), (None, "k l m n o p")]),
])
def test_copies_are_rows(spark, rows, left):
    out = dict(cp.STAGES)["near_duplicates"](spark, documents(spark, rows), "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(left, key=repr)


def test_sample_of_a_hot_text(spark):
    """A third of the rows share a text, a third have none: the measured rows stay a sample."""
    df = spark.range(300_000).selectExpr("id AS doc_id", "CASE id % 3 WHEN 0 THEN 'hot hot hot' WHEN 1 THEN concat('text ', id) END AS text").repartition(8)
    seen = spark.sparkContext.accumulator(0)
    rule = quality.Rule("count", ("n_words",), lambda n: (seen.add(len(n)), n < 0)[1], "n_words < 0")
    quality.order_rules(df, "text", [rule])
    assert 1000 < seen.value < 3000
    quality.order_rules(df, "text", [rule], sample_rows=300_000)
    assert seen.value < 3000 + 8 * quality.TASK_ROWS


assert check_pieces
