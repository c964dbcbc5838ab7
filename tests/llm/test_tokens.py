"""Encoding, decoding and the token store against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from cartulary.llm import bpe, queries, token_store
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import DOCS

tokenizers = pytest.importorskip("tokenizers")
WORDS, BYTES = (queries.tokenizer(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", "a", "aaaaaaaaaa", "It's THE <|endoftext|> end<|startoftext|>", "Ǆ ﬁ İ x̌ 日本 1234\x85y\x1cz​ ½²ª ×÷", "  a \n\n\t b  ", "''s 's 'S !'s", "ß ÿ Ñ", "x" * 3000, "<|", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    out = {}
    for p in (WORDS, BYTES):
        out[p] = tokenizers.Tokenizer.from_file(p)
        out[p].no_padding()
        out[p].no_truncation()
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abAB '!1é<|>\n", max_size=60)), max_size=5))
def test_any_text_as_the_library(texts):
    for path, own, kind in ((WORDS, bpe.load(WORDS), np.int32), (BYTES, token_store.load(BYTES), np.uint16)):
        want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)] if texts else []
        assert [np.frombuffer(x, kind).tolist() for x in own.encode(texts)] == want


def test_bpe_on_tables(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_bpe(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = library[WORDS].encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library[WORDS].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_cases_and_extra_columns(spark, library):
    rows = [(i, t, "keep") for i, t in enumerate(ODD)] + [(None, None, None), (0, "", "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, WORDS)
    assert out.columns == ["doc_id", "text", "ids"]
    got = bpe.decode(out, WORDS).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library[WORDS].encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library[WORDS].decode(ids, skip_special_tokens=False)
    assert bpe.encode(spark.createDataFrame([], DOCS), WORDS).collect() == []
    holes = spark.createDataFrame([(1, None), (2, [5, 10**6, -1])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in bpe.decode(holes, WORDS).collect()) == [(1, ""), (2, library[WORDS].id_to_token(5))]


def stored(spark, rows):
    path = token_store.write(spark.createDataFrame(rows, DOCS), BYTES)
    return path, token_store.read(spark, path).collect()


def test_token_store_round_trip(spark, sf, library):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op7_token_store(spark, sf).collect()}
    start = 0
    for i, text in docs:
        ids = [*library[BYTES].encode(text, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_store_cases(spark, monkeypatch):
    monkeypatch.setattr(token_store, "PART_TOKENS", 40)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, ODD[3]), (3, "other")]
    path, got = stored(spark, rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    assert order[0].doc_id is None and order[0].n_tokens == 1
    for row in spark.read.parquet(path).collect():
        part = token_store.Part(bytes(row.data))
        assert [part.token(i) for i in range(part.n)] == part.all().tolist() == part.tokens(0, part.n).tolist()
        with pytest.raises(IndexError):
            part.token(part.n)
    assert stored(spark, [])[1] == []


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_codes_of_any_size(ids):
    part = token_store.Part(token_store.pack(np.array(ids, np.uint32), [7], [0]))
    assert part.all().tolist() == ids == [part.token(i) for i in range(len(ids))]
