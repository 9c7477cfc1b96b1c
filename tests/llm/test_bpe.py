"""Byte BPE against the tiktoken library; token files against plain counts."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringside.llm import bpe, tokenscan

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.parse_ranks(bpe.read_ranks(PATH))
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.BlockEncoder(bpe.read_ranks(PATH), PATTERN, 1000)
TEXTS = [None, "", " ", "a" * 9001, "aaaa aaaaa", "Hello, world's 123!", "été 日本語 🎉🎉", "\n\n \t x", "<|endoftext|>", "the " * 5000]


def expected(text):
    return LIBRARY.encode_ordinary(text or "")


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab e\n'", max_size=200)), max_size=6))
@settings(max_examples=80, deadline=None)
def test_blocks_encode_like_the_library(texts):
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in ENCODER.encode(texts)]
    assert got == [expected(t) for t in texts]


def test_cache_bound_changes_nothing():
    tiny = bpe.BlockEncoder(bpe.read_ranks(PATH), PATTERN, 3)
    for _ in range(2):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in tiny.encode(TEXTS)] == [expected(t) for t in TEXTS]
    assert len(tiny.known) > 0


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, extra string")


def test_encode_and_decode(spark):
    df = docs(spark, [*TEXTS, TEXTS[5]])
    ids = bpe.encode(df, PATH, PATTERN, block_chars=100)
    back = bpe.decode(ids, PATH, block_bytes=64).orderBy("doc_id").collect()
    assert [r.ids for r in back] == [expected(t) for t in [*TEXTS, TEXTS[5]]]
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for t in [*TEXTS, TEXTS[5]]] and back[0].extra == "x"
    once = bpe.encode(df, PATH, PATTERN, packed=True, decoded_col="decoded", drop=("text",))
    assert once.columns == ["doc_id", "extra", "ids", "decoded"] and [bytes(r.decoded) for r in once.orderBy("doc_id").collect()] == [bytes(r.decoded) for r in back]
    clash = bpe.decode(bpe.encode(df.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2)), PATH, PATTERN), PATH)
    assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in clash.collect()} == {r.doc_id: (r.ids, bytes(r.decoded)) for r in back}  # they give way


def test_digests(spark):
    for r in bpe.digests(docs(spark, TEXTS), PATH, PATTERN).collect():
        t = TEXTS[r.doc_id] or ""
        ids = expected(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.digests(docs(spark, ["x"]).limit(0), PATH, PATTERN).count() == 0


def counts(blocks):
    return sorted(map(tuple, tokenscan.token_counts(blocks, 9).select("path", "doc_index", "n_tokens", "open").collect()))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_token_files_cut_anywhere(spark, size, monkeypatch):
    monkeypatch.setattr(tokenscan, "RUN", 3)  # several runs of blocks
    files = {"a": [1, 2, 9, 9, 3, 3, 3, 3, 9, 4], "b": [9], "c": [5, 6], "d": [7, 9]}
    rows = [(f, i // size, np.array(x[i : i + size], dtype="<u2").tobytes()) for f, x in files.items() for i in range(0, len(x), size)]
    want = [("a", 0, 2, False), ("a", 1, 0, False), ("a", 2, 4, False), ("a", 3, 1, True), ("b", 0, 0, False), ("c", 0, 2, True), ("d", 0, 1, False)]
    assert counts(spark.createDataFrame(rows, "path string, block long, content binary")) == want


def test_token_files_from_disk(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(np.array([1, 9, 2, 2, 9, 3], dtype="<u2").tobytes())
    (tmp_path / "g.bin").write_bytes(np.array([4] * 5000 + [9, 9], dtype="<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    for size in (2, 4, 64, 1 << 20):
        got = [(r[0][-5], *r[1:]) for r in counts(tokenscan.file_ranges(spark, str(tmp_path), block_bytes=size, range_bytes=1000))]
        assert got == [("f", 0, 1, False), ("f", 1, 2, False), ("f", 2, 1, True), ("g", 0, 5000, False), ("g", 1, 0, False)]
    none = spark.createDataFrame([], "path string, block long, content binary")
    assert counts(none) == [] and counts(spark.createDataFrame([("x", 0, None)], none.schema)) == []


def test_counts_through_flat_files(spark):
    texts = [*TEXTS, TEXTS[5]]
    df = docs(spark, texts).withColumn("file", F.lit("clash")).withColumn("n_tokens", F.lit(-1)).repartition(3)
    ids = bpe.encode(df, PATH, PATTERN, packed=True)
    for width, block in ((2, 64), (4, 1 << 20)):
        got = tokenscan.counted(ids, 50256, width=width, block_bytes=block).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(expected(t))) for i, t in enumerate(texts)]
    repeated = tokenscan.counted(ids.union(ids), 50256).collect()
    assert len(repeated) == 2 * len(texts) and tokenscan.counted(ids.limit(0), 50256).count() == 0
    with pytest.raises(ValueError, match="separator"):
        tokenscan.counted(ids, 70_000)
    for bad in ([70_000], [3, 9, 4]):
        rows = spark.createDataFrame([(1, np.array(bad, dtype="<u4").tobytes())], "doc_id long, ids binary")
        with pytest.raises(Exception, match="separator"):
            tokenscan.counted(rows, 9).collect()
