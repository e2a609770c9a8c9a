"""Token counts and byte-level BPE against their libraries, on whole tables and odd texts."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import plain

from assayline.llm import byte_bpe, queries, token_counts


def rows(df):
    return brute.order(tuple(r) for r in df.collect())


@pytest.mark.parametrize("table", ["small_docs", "odd_docs", "no_docs"])
def test_counts(spark, table, on_table, request):
    docs = request.getfixturevalue(table)
    assert rows(on_table("op1_token_counts", docs, spark)) == brute.token_counts(plain(docs))


@pytest.mark.parametrize("table", ["small_docs", "odd_docs", "no_docs"])
def test_codes(spark, table, on_table, request):
    docs = request.getfixturevalue(table)
    assert rows(on_table("op7_byte_bpe", docs, spark)) == brute.coded(plain(docs))


ODD = [
    "<|endoftext|> a<|endoftext|><|endoftext|>",
    "don't we'll 'S ''s it's'",
    " two  three   \n\n\t x \r\n",
    "a" * 3000 + " " * 700 + "é" * 300,
    "1234567 ٣٤ Ⅷ² ՘࢏౜꟎ xẞ\U0001fae9   　z",
]


def test_odd_texts_and_special_strings(spark):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(token_counts.count_tokens(df)) == brute.token_counts(docs)
    coded = byte_bpe.encode_decode(df, carry=("text",))
    assert {r.doc_id: (list(r.ids), bytes(r.decoded).decode(), r.text) for r in coded.collect()} == {
        i: (brute.CODEC.encode_ordinary(t), t, t) for i, t in docs
    }
    again = byte_bpe.decode(coded)
    assert {r.doc_id: bytes(r.decoded).decode() for r in again.collect()} == dict(docs)


def test_proven_strings_are_single_tokens():
    vocabulary = open(token_counts.public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    proven = token_counts.prove_whole_tokens(vocabulary)
    assert len(proven) > 45_000
    for text in sorted(proven)[::97]:
        assert len(brute.LIBRARY.encode(text, add_special_tokens=False).ids) == 1


def test_every_row_merges_its_leftmost_least_pair():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"aa": 257, b"aab": 258, b"abab": 259}
    pairs = byte_bpe.PairTable(ranks)
    found = byte_bpe.merge_pieces([b"aab", b"abab", b"aaaa", b"x", b"baab"], np.arange(256, dtype=np.int32), pairs)
    ids = {k: np.frombuffer(v, np.int32).tolist() for k, v in found.items()}
    assert ids == {b"aab": [258], b"abab": [259], b"aaaa": [257, 257], b"x": [120], b"baab": [98, 258]}


def test_wide_rows_merge_as_narrow_ones(monkeypatch):
    ranks = byte_bpe.read_ranks(byte_bpe.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pairs = byte_bpe.PairTable(ranks)
    bytes_ = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    pieces = [("lorem" * n).encode() for n in (3, 40, 200)]
    narrow = byte_bpe.merge_pieces(pieces, bytes_, pairs)
    monkeypatch.setattr(byte_bpe, "WIDE", 4)
    assert byte_bpe.merge_pieces(pieces, bytes_, pairs) == narrow


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_new_words_are_split_together():
    """As each alone: words with white space at the end, empty ones, signs, digits and letters of other scripts."""
    ranks = byte_bpe.read_ranks(byte_bpe.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = byte_bpe.Codec(ranks, byte_bpe.PairTable(ranks), byte_bpe.public_tokenizers.PATTERN)
    texts = [" ".join(f"wort{i * 7919 % 5003}{'!' * (i % 3)}\n{i}" for i in range(4000)), "a b\n", "x ", "", " y", "it's 'S b\n", *ODD]
    calls = []
    plain = codec.split.pattern
    codec.split.pattern = type("Counted", (), {"findall": lambda _, t: calls.append(t) or plain.findall(t), "finditer": plain.finditer})()
    ids, ends = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [brute.CODEC.encode_ordinary(t) for t in texts]
    assert codec.decode(ids, ends).to_pylist() == [t.encode() for t in texts]
    assert len(calls) < 200
    words = ["b\n", "don't", "", "１２", "é3 ", "日本", "x" * 99]
    order, pieces, begins = codec.split.behind_blank(words)
    assert sorted(order) == sorted(words)
    assert [pieces[a:b] for a, b in zip(begins, [*begins[1:], len(pieces)], strict=True)] == [codec.split(" " + w) for w in order]
    for some in ([], [""], ["", ""]):
        ids, ends = codec.encode(pa.array(some, pa.string()))
        assert not len(ids) and codec.decode(ids, ends).to_pylist() == [t.encode() for t in some]
