"""Operator 1 against tiktoken on the same ranks."""

import hashlib

import public_tokenizers as P
import pytest

from vigilspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "Hello  world\n\n", "naïve Ünïcödé ñandú 12345", "a" * 5000, "\x00\x7f­", "🎉🎉 家族 ▁x", "don't I'll\t\tx  ", "!!!???...", "x" * 70 + " " + "y" * 70, "\r\n \r\n"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_and_bytes(spark, tiktoken_encoding):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, TEXTS[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, PATH, P.PATTERN)
    found = {r.doc_id: r for r in bpe.digests(encoded).collect()}
    for i, t, _ in rows:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_table_of_bounded_size(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    ranks = bpe.read_ranks(PATH)
    codec = bpe.Codec(ranks, bpe.serialise_model(ranks), P.PATTERN)
    for text in ("one two three four five six seven", "one two", "eight nine ten eleven", "one ten"):
        assert codec.encode([text, text]) == [",".join(map(str, tiktoken_encoding.encode_ordinary(text)))] * 2
        assert len(codec.known) <= 7


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
