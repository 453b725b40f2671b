"""Spelling variants against a plain search through all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandsort.llm import spelling_variants as V


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    v = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    same, near = defaultdict(set), defaultdict(set)
    for w in v:
        for i in range(len(w)):
            same[w[:i] + "\0" + w[i + 1 :]].add(w)
            x = w[:i] + w[i + 1 :]
            if x in v:
                near[w].add(x)
                near[x].add(w)
    for ws in same.values():
        for a in ws:
            near[a] |= ws - {a}
    first = {w: min(near[w], key=lambda x: (-v[x], x)) for w in v if near[w]}
    form = {w: x for w, x in first.items() if v[x] >= 10 * v[w]}
    out = {}
    for w in v:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, v[w], len(near[w]), v[form[w]] if w in form else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(stems[: rng.choice([3, 10, 60])])
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdeéÿ") + w[k + 1 :], w[:k] + rng.choice("aé") + w[k:]])
            words.append(rng.choice([w, w.title(), w.upper()]))
        rows.append((i, " ".join(words)))
    chain = ["aaaabbbb"] * 3 + ["aaaabbbc"] * 40 + ["aaaabbcc"] * 500  # a form of a form, and runs of one letter
    rows += [(1000 + i, w) for i, w in enumerate(chain)]
    rows += [(None, "nothing nothing"), (None, None), (5000, ""), (5001, "×÷×÷×÷×÷ ×÷×÷×÷×÷"), (5002, "x1y2-" * 50), (5003, "longer" * 20_000 + " " + "longer" * 20_000), *rows[:3]]
    return rows


def test_variants_against_all_words(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "near": F.lit("y")}).repartition(5)
    want = plain(rows)
    assert result(V.spelling_variants(df)) == want
    assert any(f is not None and f != r for f, r, *_ in want.values())
    # filters that don't fit are split by hash, with the same result
    assert V.block_counts({n: 10_000 for n in range(7, 12)}, 2048)[1] > 4
    assert result(V.spelling_variants(df, filter_bytes=128)) == want


def test_variants_of_an_empty_table(spark):
    assert V.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_columns(spark):
    got = V.op13_spelling_variants(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert result(got) == plain([tuple(r) for r in docs])


def test_edit_hashes_and_filters():
    """Every edit that is in the vocabulary passes, few others do, and an edit's hash is that of the word it makes."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(3000)})
    (_, matrix), *_ = V.by_length(pa.array(words), 1 << 20)
    blocks, parts = V.block_counts({9: len(words)}, 1 << 20)
    filters = V.Filters({9: np.zeros((blocks[9], V.BLOCK_WORDS), np.uint64)})
    h = V.mixed(V.sums(matrix))
    block = ((h >> np.uint64(40)) & np.uint64(blocks[9] - 1)).astype(np.int64)
    for at, bit in V.bits_of(h):
        np.bitwise_or.at(filters.blocks[9], (block, at.astype(np.int64)), bit)
    assert parts == 1
    assert filters.knows(9, V.sums(matrix)).all()
    others = [w[:4] + "z" + w[5:] for w in words]
    (_, wrong), *_ = V.by_length(pa.array(others), 1 << 20)
    assert filters.knows(9, V.sums(wrong)).mean() < 0.01
    known = set(words)
    hits = [(words[r], w) for row, made in V.edits(matrix, np.array([ord(c) for c in "abcdefgh"], np.uint64), filters) for r, w in zip(row, made, strict=True)]
    assert {(a, b) for a, b in hits if b in known} == {(w, x) for w in words for i in range(9) for c in "abcdefgh" if c > w[i] and (x := w[:i] + c + w[i + 1 :]) in known}
