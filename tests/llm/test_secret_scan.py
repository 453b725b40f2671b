"""Candidates against a plain Python version, and texts that would take a backtracking pattern or a repeated split too long."""

from __future__ import annotations

import random
import re
import string
import time

import pytest

from strandsort.llm import secret_scan

# the patterns as they are meant, without look-aheads that save work
NAMED = re.compile(rf"(?<![\w.-])[\w.-]*?(?i:{secret_scan.CREDENTIAL})[\w.-]*[ \t]*[=:][ \t]*", re.A)
CANDIDATE = re.compile(rf"(?:{NAMED.pattern})(?:\"[^\"\n]+\"|'[^'\n]+'|[^\s\"',;]+)|{secret_scan.RUN}", re.A)
LEAD = re.compile(rf"(?:{NAMED.pattern})[\"']?", re.A)


def words(text):
    return [w for w in re.split(r"[^a-zé]+", text.lower()) if w and not re.match(rf"(?:{secret_scan.CREDENTIAL})\Z", w)]


def plain(text):
    out, hits = [], list(CANDIDATE.finditer(text))
    for k, m in enumerate(hits):
        lead = LEAD.match(m[0])
        n = lead.end() if lead else 0
        value = re.sub(r"\A(.*[^\"'])[\"']$", r"\1", m[0][n:]) if n else m[0]
        before = text[hits[k - 1].end() if k else 0 : m.start()] + m[0][:n]
        after = text[m.end() : hits[k + 1].start() if k + 1 < len(hits) else len(text)]
        credential = re.search(rf"(?i:{secret_scan.CREDENTIAL})[\w.-]*\s*[=:]?\s*[\"']?$", before, re.A)
        if value:
            out.append((m.start() + n, m.start() + n + len(value), value, words(before)[::-1][:3], words(after)[:3], bool(re.search(r"[=:]\s*[\"']?$", before, re.A)), before[-1:] in ("'", '"'), bool(credential)))
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_scan.candidates(df, secret_scan.Settings()).collect()
    by = {i: [] for i in range(len(texts))}
    for r in rows:
        by[r["doc_id"]].append((r["start"], r["end"], r["candidate"], r["words_before"], r["words_after"], r["assigned"], r["quoted"], r["credential"]))
    return [sorted(v) for v in by.values()]


def test_candidates_against_plain_python(spark):
    rng = random.Random(2)
    bits = ["token", "Password", "api-key", "x", "é", " ", "  ", "\t", "\n", "=", ":", '"', "'", ";", ",", ".", "-", "_", "key", "Abc1", "deadbeef0123456789", "AbCdEfGhIjKlMn", "a/b/c1/d2/e3/f4", "word", "the"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(600)] + ["", "token", "token=", "token='", 'pwd="a b"x', "a.token=1 token=2"]
    got = found(spark, texts)
    for t, g in zip(texts, got, strict=True):
        assert g == plain(t), t
    assert sum(map(len, got)) > 500


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (" ".join("".join(random.Random(i).choice(string.ascii_letters) for _ in range(23)) + "7" for i in range(20_000)), 20_000),
        ("token" * 40_000 + " x=1", 1),
        ("token" * 40_000 + "=;", 0),
        ("token" + " " * 100_000 + "é key abcdefghijkl12345", 1),
        (("token" + " " * 100) * 2000 + "é key abcdefghijkl12345", 1),
        ("a='" * 50_000 + "abcdefghijkl12345", 1),
        ("token=\"" * 30_000 + "abcdefghijkl12345", 15_001),
        ("A1b2" * 250_000, 1),
    ],
    ids=["many", "names", "names-and-sign", "blanks", "many-blanks", "quotes", "open-quotes", "long-run"],
)
def test_long_texts_take_linear_time(spark, text, n):
    began = time.perf_counter()
    assert len(found(spark, [text])[0]) == n
    assert time.perf_counter() - began < 25


def test_pairs_of_a_long_candidate(spark):
    """A candidate of 400,000 characters goes through all features, and is not copied for each of its characters."""
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.createDataFrame([("aé1b",)], "t string").select(F.explode(secret_scan.pairs_of(F.col("t")))).collect()] == ["aé", "é1", "1b"]
    df = spark.createDataFrame([(1, "ab1" * 130_000 + " word"), (2, "see token=abc")], "doc_id long, text string")
    began = time.perf_counter()
    assert sorted((r["doc_id"], r["end"] - r["start"]) for r in secret_scan.scan(df).collect()) == [(1, 390_000), (2, 3)]
    assert time.perf_counter() - began < 60


def test_query_columns(spark):
    got = secret_scan.op3_secret_scan(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "end", "candidate_sha256", "named", "score", "secret"]
    docs = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    rows = got.collect()
    assert len(rows) == sum(len(plain(t)) for t in docs.values())
