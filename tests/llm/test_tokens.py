"""Token files and packing against the tokenizers library on whole texts."""

import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from llm_fixtures import HARD_TEXTS, SF0001, documents, long_text  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventlens.llm import packing, token_files
from eventlens.llm.queries import QUERIES, tokenizer_file
from eventlens.session import scratch_path


def whole(name, texts):
    t = Tokenizer.from_file(P.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


SPECIAL = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|>", "x <|endoftext|>.", "<|endoftext|", " <|endoftext|> \n <|endoftext|>", "one\n\n<|endoftext|>\n two", "plain words"]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word_end"), ("byte_bpe_50k.json", "byte_level")])
def test_special_strings_as_the_library_reads_them(name, kind):
    import pyarrow as pa
    from eventlens.llm.tokens import Encoder
    enc = Encoder(str(P.path(name)), kind == "byte_level", 1000)
    for texts in (SPECIAL, SPECIAL + [t or "" for t in HARD_TEXTS]):
        ids, offsets = enc.encode(pa.array(texts))
        assert [ids[a:e].tolist() for a, e in zip(offsets[:-1], offsets[1:])] == whole(name, texts)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("rows", [0, 1, 40])
def test_token_files_hard_texts(spark, long_text, rows):
    texts = ([long_text] + HARD_TEXTS + HARD_TEXTS + [long_text[:999]])[:rows]
    docs = [(None if i == 3 else i // 2 * 5, t) for i, t in enumerate(texts)]
    path = scratch_path(spark, "t")
    token_files.write_tokens(documents(spark, docs, ["ids", "file"]), path, tokenizer_file("word_bpe_49k.json"), files=3)
    got = token_files.read_tokens(spark, path).orderBy("file", "file_start").collect()
    want = sorted(zip(docs, whole("word_bpe_49k.json", [t for _, t in docs])), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, (x[0][1] or "").encode()))
    assert [(r.doc_id, list(r.ids), r.n_tokens) for r in got] == [(d[0], ids + [1], len(ids) + 1) for d, ids in want]
    if rows == 40:
        some = token_files.read_tokens(spark, path, 10, 20)
        assert {r.doc_id for r in some.collect()} == {10, 15, 20}
        assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in some._jdf.queryExecution().toString()


def test_token_files_query(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, {}
    for d, ids in zip(docs, whole("word_bpe_49k.json", [d.text for d in docs])):
        want[d.doc_id] = (at, len(ids) + 1, crc(ids + [1]))
        at += len(ids) + 1
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, SF0001).collect()}
    assert got == want


def test_token_files_format(spark, tmp_path):
    import pyarrow.parquet as pq
    path = str(tmp_path / "f")
    token_files.write_tokens(spark.read.parquet(f"{SF0001}/documents.parquet"), path, tokenizer_file("word_bpe_49k.json"), files=2)
    file = next(p for p in sorted((tmp_path / "f").glob("*.parquet")))
    meta = pq.ParquetFile(file).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for c, m in columns.items() if c.startswith("ids") for e in m.encodings)
    assert columns["doc_id"].encodings == ("DELTA_BINARY_PACKED",) or "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def check_pieces(pieces, docs, width):
    """Each id in one piece, sequences within width and gapless; returns the fill."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(docs)
    for d, ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        ids = []
        for p in ps:
            assert p.start == len(ids) and p.doc_tokens == len(docs[d])
            ids += np.frombuffer(bytes(p.ids), "<u4").tolist()
            assert p.length == len(p.ids) // 4 > 0
        assert ids == docs[d]
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at
            at += p.length
        assert at <= width
    return sum(p.length for p in pieces) / (width * len(by_seq)) if by_seq else 1


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_packing(spark, long_text, parts):
    texts = HARD_TEXTS + [long_text] + [long_text[: 40 * i] for i in range(120)]
    docs = documents(spark, list(enumerate(texts)), ["ids", "length"]).repartition(parts)
    want = {i: ids + [0] for i, ids in enumerate(whole("byte_bpe_50k.json", texts))}
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), fan=4).collect()
    assert check_pieces(pieces, want, 1024) > 0.9


def test_packing_empty_and_few_windows(spark):
    assert packing.pack(documents(spark, []), tokenizer_file("byte_bpe_50k.json")).count() == 0
    docs = [(i, "a " * (i % 37)) for i in range(50)]
    want = {i: ids + [0] for i, ids in enumerate(whole("byte_bpe_50k.json", [t for _, t in docs]))}
    pieces = packing.pack(documents(spark, docs), tokenizer_file("byte_bpe_50k.json"), width=40, open_windows=2).collect()
    check_pieces(pieces, want, 40)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    ids = {d.doc_id: x + [0] for d, x in zip(docs, whole("byte_bpe_50k.json", [d.text for d in docs]))}
    got = QUERIES["op5_pack_online"](spark, SF0001)
    seen = {}
    for r in got.collect():
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: len(x) for d, x in ids.items()}
    fill = got.agg(F.sum("length") / (F.countDistinct("sequence_id") * 1024)).first()[0]
    assert fill > 0.95, uuid.uuid4()
