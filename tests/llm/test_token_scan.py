"""Chunks' state maps of texts that never forget: few rounds of mapping, log rounds of composing, and the library's counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandsort.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize(("text", "chunk", "lead", "mapping"), [("a" * 6001, 150, 20, 2), ("=" * 6001, 150, 20, 3), ("na" * 3000, 150, 20, 2), ("a b\n" * 1500 + "12" * 1000, 100, 30, 2), ("a" * 1_000_000, 1 << 14, 256, 1)])
def test_rounds_grow_with_the_logarithm_of_chunks(spark, monkeypatch, text, chunk, lead, mapping):
    rounds = {}
    for name in ("closed", "composed"):
        plain = getattr(token_counts, name)

        def counted(*a, plain=plain, name=name):
            out = plain(*a)
            rounds[name] = out[1]
            return out

        monkeypatch.setattr(token_counts, name, counted)
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text[: 3 * chunk] + "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, MODEL, chunk=chunk, lead=lead).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got == {1: len(library.encode(text)), 2: len(library.encode("short")), 3: len(library.encode(text[: 3 * chunk] + "x"))}
    chunks = -(-(len(text) + 1) // chunk)
    assert rounds["closed"] <= mapping and rounds["composed"] == (chunks - 1).bit_length()


def test_query_columns_and_limit(spark):
    """over_limit turns at 4096 tokens; n_bytes are of UTF-8."""
    got = token_counts.op4_token_counts(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    want = {i: (len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in docs.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()} == want
    assert {w[2] for w in want.values()} == {True, False}
    edge = spark.createDataFrame([(1, "x " * 4096), (2, "x " * 4097)], "doc_id long, text string").withColumn("text", F.rtrim("text"))
    counts = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(edge, MODEL).collect()}
    assert counts == {1: (4096, False), 2: (4097, True)}
