"""Byte-level BPE: ids equal the tiktoken library's, decoding is exact."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN

from tidemark.llm import bpe, queries

NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    own = bpe.encoding(bpe.ranks_path(request.param))
    return own, library(own.vocabulary.ranks)


def same(both, text):
    own, lib = both
    raw = own.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == lib.encode_ordinary(text)
    assert own.decode(np.frombuffer(raw, "<u4")) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    own = bpe.encoding(bpe.ranks_path())
    same((own, library(own.vocabulary.ranks)), text)


def test_pieces_that_need_backtracking(both):
    own, lib = both
    r = random.Random(3)
    words = list(own.vocabulary.word.values())
    for i in range(6000):
        piece = b"".join(r.choices(words, k=r.randint(1, 4))) if i % 3 else bytes(r.choices(b"abcdeinorst ", k=r.randint(1, 40)))
        assert own.vocabulary.encode_piece(piece) == lib._core_bpe.encode_single_piece(piece)


def test_runs_and_long_texts(both):
    for text in ("", " ", "\n\n  \t x", "a" * 5000, " " * 3000 + "x", "=" * 700, "日本語" * 900, "é́\U0001f600'S 'll don't 12 3", "no blank" * 400):
        same(both, text)
    r = random.Random(5)
    long = " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(260_000))
    assert len(long) > bpe.LONG  # is cut lazily
    same(both, long)


def test_one_long_piece_takes_linear_work():
    own = bpe.encoding(bpe.ranks_path())
    r = random.Random(7)
    text = "".join(r.choices("abcdefgh", k=1 << 20))
    raw = own.encode(text + "z")  # the library needs its own time for this; the round trip is exact
    assert own.decode(np.frombuffer(raw, "<u4")).decode() == text + "z"


def test_tokens_no_merge_leads_to_are_for_whole_pieces_only():
    plain = {bytes([b]): b for b in range(256)}
    ranks = plain | {b"cd": 256, b"abc": 257, b"bcd": 258}  # neither ab nor bc is there
    v = bpe.Vocabulary(ranks)
    lib = library(ranks)
    assert 257 not in v.halves and 258 in v.halves
    for piece in (b"abc", b"abcd", b"xabc", b"bcd", b"abcabc", b"cdcd", b"bcbcd"):
        assert v.encode_piece(piece) == lib._core_bpe.encode_single_piece(piece), piece
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        bpe.Vocabulary(plain | {b"abc": 256, b"bc": 257})  # abc from a and bc, which ranks later


def test_memory_is_bounded(monkeypatch):
    own = bpe.Encoding(bpe.read_ranks(bpe.ranks_path()), PATTERN)
    monkeypatch.setattr(bpe, "STORE", 20_000)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    text = " ".join(f"w{i}rt{i * i}" for i in range(3000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library(own.vocabulary.ranks).encode_ordinary(text)
    assert own.pieces.held <= 20_000 and len(own.vocabulary._pairs) <= 50
    own.encode("q" * 100_000)
    assert all(len(k) <= bpe.SHORT for k in own.pieces)


def test_documents(spark, monkeypatch):
    rows = [(1, "One two."), (1, "One two."), (None, "null id"), (4, None), (5, ""), (6, "<|endoftext|> \u0000"), (7, "x" * 70_000)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    lib = library(bpe.encoding(bpe.ranks_path()).vocabulary.ranks)
    e = bpe.encode_documents(d)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in e.collect()) == sorted((i or 0, lib.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r.doc_id or 0, bytes(r.data)) for r in bpe.decode_documents(e).collect()) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    assert bpe.digests(bpe.encode_documents(d.limit(0))).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.digests(nothing).first().n_tokens == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_documents(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>")).collect()
    broken = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")  # not UTF-8
    assert bytes(bpe.decode_documents(bpe.encode_documents(broken)).first().data) == "a�b".encode()


def test_query(spark, sf):
    lib = library(bpe.encoding(bpe.ranks_path()).vocabulary.ranks)
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op13(spark, sf).collect()} == want
