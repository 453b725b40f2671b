"""Null ids, and batches that are cut by bytes."""

from __future__ import annotations

import pyarrow as pa

from strandsort.llm import language_id


def test_null_ids_are_learned_from_and_not_held_out(spark, tmp_path):
    rows = [(None if i % 5 == 0 else i, "the cat and the dog " * 5 if i % 2 else "der hund und die katze " * 5, "en" if i % 2 else "de") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = language_id.op8_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 60 and {r["held_out"] for r in got if r["doc_id"] is None} == {False} and {r["held_out"] for r in got} == {True, False}
    assert {r["lang_pred"] for r in got} == {"en", "de"}


def test_batches_are_cut_by_rows_and_bytes():
    texts = ["x" * 3_000_000, "a", None, "b" * 1_500_000, "c" * 1_500_000, *["d"] * 600]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)))], names=["text", "n"])
    found = list(language_id.parts(batch))
    assert [n for p in found for n in p.column("n").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 256 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 2_000_000) for p in found)
    assert list(language_id.parts(batch.slice(0, 0))) == []
