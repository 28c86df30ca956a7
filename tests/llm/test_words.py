"""Word kernels against Python, also on slices of a batch."""

import re

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import HARD_TEXTS

from eventlens.llm import ngram_join, quality, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("at,n", [(0, None), (3, 9), (11, 30), (5, 0)])
def test_slices(kind, at, n):
    texts = HARD_TEXTS * 3 + ["ÉA B c " * 50, "x y z a b c d e f g h i " * 30]
    part = pa.array(texts, kind).slice(at, n)
    w = words.words_of(part)
    vocabulary = w.vocabulary.to_pylist()
    got = [[vocabulary[c] for c in w.codes[a:e]] for a, e in zip(w.offsets[:-1], w.offsets[1:])]
    assert got == [WORD.findall(t or "") for t in part.to_pylist()]
    sets, offsets = ngram_join.shingle_sets(part)
    for t, a, e in zip(part.to_pylist(), offsets[:-1], offsets[1:]):
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) > 4 else ({tuple(ws)} if ws else set())
        assert e - a == len(want) == len(np.unique(sets[a:e]))
    batch = quality.Batch(part)
    rows = np.arange(len(part))
    assert batch.n_words(rows).tolist() == [len(x) for x in got]
    assert batch.word_chars(rows).tolist() == [sum(map(len, x)) for x in got]


def test_equal_words_hash_alike_everywhere():
    one = words.string_hashes(pa.array(["ab", "b", "", "é", "ab"]))
    two = words.string_hashes(pa.array(["q", "é", "ab", "b", ""]).slice(1))
    assert one[0] == one[4] == two[1] and one[3] == two[0] and one[1] == two[2] and one[2] == two[3]
    assert len(set(words.string_hashes(pa.array([str(i) for i in range(20000)])).tolist())) == 20000
