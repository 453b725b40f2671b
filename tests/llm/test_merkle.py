"""The Merkle manifest against a plain Python version that keeps every level."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strandsort.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r: dict, tampered: bool = False) -> str:
    told = ""
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        v = r[name]
        if name == "text" and tampered and v is not None:
            v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
        told += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(told)


def all_levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows: list[dict]) -> list[tuple]:
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    trees = {}
    for lang, own in by.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[lang] = all_levels([leaf_of(r) for r in own])
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    top = all_levels([trees[x][-1][0] for x in langs])
    out = []
    for lang, own in by.items():
        for i, r in enumerate(own):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node, seen = leaf_of(r, hit), ""
            for levels, k in ((trees[lang], i), (top, langs.index(lang))):
                for nodes in levels[:-1]:
                    run = nodes[k - k % 8 : k - k % 8 + 8]
                    seen += "".join(x for j, x in enumerate(run) if j != k % 8)
                    run[k % 8] = node
                    node, k = h("".join(run)), k // 8
            root = top[-1][0]
            out.append((r["doc_id"], trees[lang][0][i], trees[lang][-1][0], root, h(seen), node, node == root))
    return out


def found(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def key(t: tuple) -> tuple:
    return (t[0] is not None, t[0] or 0, t[1:])


def test_merkle_against_all_levels(spark):
    """Trees of one leaf, of one block, and of more than two stored levels' reach, null fields, repeated rows, clashing columns."""
    rows = [{"doc_id": i, "text": f"Text {i % 900} É", "lang": "en", "source": "s", "n_chars": i} for i in range(4700)]
    rows += [{"doc_id": i, "text": "X" * i, "lang": "", "source": None, "n_chars": None} for i in range(9)]
    rows += [{"doc_id": 7, "text": "Copy", "lang": None, "source": "a", "n_chars": 4}] * 70
    rows += [{"doc_id": None, "text": t, "lang": None, "source": "a", "n_chars": 4} for t in ("", None, "A b", "a b")]
    rows += [{"doc_id": 3, "text": "Alone", "lang": "zz", "source": "1:x", "n_chars": 5}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumns({"TEXT2": F.lit("x"), "digest": F.lit(1), "idx": F.lit(2), "tree": F.lit("t")})
    assert sorted(found(merkle.verified_documents(df.repartition(7))), key=key) == sorted(plain(rows), key=key)


def test_merkle_empty(spark):
    assert merkle.verified_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merkle_query_columns_and_tampering(spark):
    got = merkle.op11_merkle(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")]
    docs = {r["doc_id"]: r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(found(got), key=key) == sorted(plain(list(docs.values())), key=key)


def test_merkle_proofs_of_some_from_a_saved_manifest(spark, tmp_path):
    """Only stored levels are written; proofs of single leaves are regenerated from them and lead to the root."""
    rows = [(i, f"text {i}", "en" if i % 3 else "de", "s", i) for i in range(3000)]
    built = merkle.documents_manifest(spark.createDataFrame(rows, SCHEMA))
    built.save(str(tmp_path / "m"))
    m = merkle.Manifest.load(spark, str(tmp_path / "m"))
    assert sorted(m.levels) == [0, 3]
    assert m.levels[3].count() == 4 + 2  # 2000 and 1000 leaves in blocks of 512
    root = merkle.with_top(m).first()["root"].hex()
    wanted = spark.createDataFrame([("=en", 0), ("=en", 1999), ("=de", 513)], "tree string, idx long")
    make = lambda r, s, t: {"tree": r["tree"], "idx": r["idx"], "leaf": r["digest"], "steps": s}
    proofs = merkle.prove(m, merkle.with_top(m), make, ["subroot", "root"], f"tree string, idx long, leaf binary, steps {merkle.STEPS}", wanted).collect()
    assert sorted((p["tree"], p["idx"]) for p in proofs) == [("=de", 513), ("=en", 0), ("=en", 1999)]
    assert all(merkle.fold(p["leaf"].hex(), [s.asDict() for s in p["steps"]]) == root for p in proofs)
    assert all(merkle.fold("0" * 64, [s.asDict() for s in p["steps"]]) != root for p in proofs)
