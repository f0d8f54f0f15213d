"""Byte-level BPE against the public encoder of the same vocabulary."""

import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = byte_bpe.read_ranks(PATH)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = byte_bpe.Codec(byte_bpe.serialise(RANKS), PATTERN)


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13_equals_the_public_encoder(spark, d):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op13_byte_bpe"](spark, d).collect()}
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = PLAIN.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want and len(want) > 100


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == PLAIN.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_every_code_point_is_split_alike():
    for base in range(0, 0x110000, 4096):
        text = " ".join(f"a{chr(c)}1{chr(c)}" for c in range(base, base + 4096) if not 0xD800 <= c < 0xE000)
        assert CODEC.encode(text).tolist() == PLAIN.encode_ordinary(text)


def test_edges(spark):
    long = "é" * 30_000 + " " * 9_000 + "ab" * 40_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|>", "x"), (3, "<|endoftext|>", "x"), (None, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(1)
    codec = byte_bpe.tokenizer(spark, PATH, PATTERN)
    for packed in (False, True):
        out = codec.decode(codec.encode(docs, ids="own", packed=packed), "own", "a.b").collect()
        want = [PLAIN.encode_ordinary(r[1] or "") for r in rows]
        assert [r.own if not packed else struct.unpack(f"<{len(r.own) // 4}I", r.own) for r in out] == [tuple(w) if packed else w for w in want]
        assert [bytes(r["a.b"]).decode() for r in out] == [r[1] or "" for r in rows] and [r.ids for r in out] == ["x"] * 4 + [None]
        assert codec.encode(docs.limit(0), packed=packed).count() == 0 and codec.encode(docs).columns == ["doc_id", "text", "ids"]
    nothing = docs.limit(1).select(F.lit(None).cast("array<int>").alias("ids"))
    assert codec.decode(nothing).first().decoded is None
    with pytest.raises(Exception, match="not of this vocabulary"):
        codec.decode(docs.select(F.array(F.lit(len(RANKS))).alias("ids"))).collect()


def test_results_are_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, "some words " * (i % 7)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(byte_bpe, "HELD", 100)
    assert [r.ids for r in byte_bpe.tokenizer(spark, PATH, PATTERN).encode(docs).collect()] == [PLAIN.encode_ordinary(t) for _, t in rows]


def test_bytes_that_are_not_utf8(spark):
    codec = byte_bpe.tokenizer(spark, PATH, PATTERN)
    got = codec.encode(spark.range(1).select(F.unhex(F.lit("61FF62")).cast("string").alias("text"))).first().ids
    assert got == PLAIN.encode_ordinary("a\ufffdb")


def test_small_vocabularies():
    """A vocabulary with a token that no merge gives, and ones that aren't whole."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"xyz": 258}
    codec, plain = byte_bpe.Codec(byte_bpe.serialise(ranks), PATTERN), tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "abc", "ababc", "xyzxyz", " xyz", "xyz1", "aab"):
        assert codec.encode(text).tolist() == plain.encode_ordinary(text)
    for bad in ({b"a": 0}, ranks | {b"new": 300}):
        with pytest.raises(ValueError):
            byte_bpe.serialise(bad)
