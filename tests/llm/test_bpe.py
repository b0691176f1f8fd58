import hashlib

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import odd_rows, table

from vecspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
VOCABULARY = bpe.Vocabulary(RANKS)
SPLIT = regex.compile(public_tokenizers.PATTERN)
TRUE = tiktoken.Encoding("true", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(), st.text("abeinorst \n'*1é中🙂", max_size=200)))
def test_as_the_library(text):
    ids = VOCABULARY.encode(text, SPLIT)
    assert ids == TRUE.encode_ordinary(text)
    assert VOCABULARY.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text("thanier", min_size=1, max_size=400), st.integers(0, 400), st.integers(0, 20), st.text("thanier", max_size=8))
def test_appends_and_edits(text, begin, length, new):
    begin = min(begin, len(text))
    end = min(begin + length, len(text))
    piece = bpe.Prefixes(VOCABULARY, text[: len(text) // 2].encode())
    piece.append(text[len(text) // 2 :].encode())
    assert piece.ids() == VOCABULARY.walk(VOCABULARY.last_tokens(text.encode(), []))
    piece.replace(begin, end, new.encode())
    assert piece.data == (text[:begin] + new + text[end:]).encode()
    assert piece.last == VOCABULARY.last_tokens(piece.data, [])


def test_an_edit_is_local():
    piece = bpe.Prefixes(VOCABULARY, b"information" * 2000)
    assert piece.replace(500, 503, b"xyz") < 500


def test_bounded_memory():
    table = bpe.Remembered(lambda k: -k, most=10)
    assert [table(k) for k in range(100)] == [-k for k in range(100)]
    assert len(table.new) <= 10 and len(table.old) <= 10


def test_odd_tables(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "7 as n_tokens", "'x' as ids")
    got = bpe.encode_documents(docs, PATH, digests=True)
    assert got.columns == [*[c for c in docs.columns if c not in ("n_tokens", "ids")], "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        want = TRUE.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    decoded = bpe.decode_documents(got, PATH).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in decoded)
    assert bpe.encode_documents(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("piece", ["a" * 5000, " " * 3000 + "x", "é" * 2000])
def test_long_pieces(piece):
    assert VOCABULARY.encode(piece, SPLIT) == TRUE.encode_ordinary(piece)
