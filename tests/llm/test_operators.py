"""The ten operators against brute force, with edge cases: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import os
import random
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsort.llm import decontamination, jaccard_join, language_id, packing, pii, quality_rules, secret_scan, sharding, token_counts, url_rules
from strandsort.llm.token_ids import TokenIds

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, _row string"


def words(rng, n, vocabulary=400):
    return " ".join("w" + format(rng.randrange(vocabulary), "03x") for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """A small corpus with every edge case; columns node and _row clash with names inside the operators."""
    rng = random.Random(1)
    base = [words(rng, 120) for _ in range(25)]
    texts = base + [base[0]] * 3 + [base[1].upper(), base[2] + " tail", "  " + base[3].replace(" ", "\n")]
    near = base[4].split()
    for k in range(6):
        near = [*near[: 10 * k], "changed", *near[10 * k + 1 :]] if k < 5 else near
        texts.append(" ".join(near))
    texts += [None, None, "", " \n ", "one two", "One  two", "x" * 3000, words(rng, 9000), "reach me: ab@mail.example.com or +1 (555) 123-4567, 10.1.2.3 now"]
    rows = [(i, t, "en" if i % 3 else "fr", "s", len(t or ""), 7, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (None, base[6], None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(corpus, empty):
    def brute(text):
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked) if marked is not None else None

    got = quality_rules.judge(corpus).collect()
    assert len(got) == corpus.count()
    for r in got:
        want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        assert want[4] in (None, r.n_repeat_words)
        assert not (r.base_failed and r.kept)
    repeated = corpus.sparkSession.createDataFrame([(1, "a b c a b c x\nq\nq"), (2, "a a a a"), (3, "a b")], "doc_id long, text string")
    assert [r.n_repeat_words for r in quality_rules.judge(repeated).orderBy("doc_id").collect()] == [6, 4, 0]
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep_good(corpus)
    assert kept.columns == corpus.columns and kept.count() == sum(r.kept for r in got)


def jaccard_classes(rows):
    sets = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    link = [[i != j and near(a, b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in range(len(rows)) if link[i][j])]) for i in range(len(rows))]
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(least.get(label[i], d), d)
    return sorted([(d, least.get(label[i]), sum(link[i])) for i, (d, _) in enumerate(rows)], key=str)


def test_jaccard_join(corpus, empty):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    for forest in (jaccard_join.Forest(), jaccard_join.Forest(block=4, broadcast_rows=0)):
        got = jaccard_join.near_duplicates(corpus, forest=forest)
        assert sorted([tuple(r) for r in got.collect()], key=str) == jaccard_classes(rows)
    kept = jaccard_join.keep_one(corpus)
    assert kept.columns == corpus.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for d, c, _ in jaccard_classes(rows) if d == c and d is not None}
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_null_and_repeated_ids_keep_their_rows(spark):
    """Rows are known by id and text: what shares an id, or has none, is neither dropped for another's sake nor spared."""
    rng = random.Random(12)
    a, b, c, d, item = (words(rng, 60, 4000) for _ in range(5))
    held = f"{words(rng, 30, 4000)} {item} {words(rng, 30, 4000)}"
    rows = [(None, a), (None, b), (None, b), (None, b + " tail"), (7, c), (7, d), (3, d), (7, held), (None, held + " x"), (None, None), (None, ""), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for forest in (jaccard_join.Forest(), jaccard_join.Forest(broadcast_rows=0)):
        kept = sorted([tuple(r) for r in jaccard_join.keep_one(df, forest).collect()], key=str)
        assert [r for r in kept if r[1] in (b, b + " tail")] in ([(None, b)], [(None, b + " tail")])
        assert [r for r in kept if r[1] not in (b, b + " tail")] == sorted([(None, a), (7, c), (3, d), (7, held), (None, None), (None, ""), (8, ""), (8, "")], key=str)
    for most in (1_000_000, 0):
        clean = decontamination.drop_contaminated(df, bench, broadcast_rows=most)
        assert sorted(map(str, clean.collect())) == sorted(str(r) for r in df.collect() if item not in (r.text or ""))


def test_decontamination(spark, corpus, empty):
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate((12, 20, 20, 35))] + [(9, None), (10, "")]
    docs, want = [], set()
    for k in range(24):
        item, ws = k % 4, words(rng, 80, 4000).split()
        own = items[item][1].split()
        for _ in range(int(0.1 * len(own)) * (k % 3 > 0)):
            own[rng.randrange(len(own))] = "other"
        docs.append((k, " ".join(ws[:40] + own + ws[40:])))
        want.add((k, item))
    docs += [(100, items[0][1]), (101, None), (102, ""), (103, words(rng, 30, 4000)), (0, docs[0][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for search in (decontamination.Search(), decontamination.Search(block_words=30)):
        got = decontamination.contaminated(df, bench, search).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want | {(100, 0)}
    exact = next(r for r in got if r.doc_id == 3)
    assert docs[3][1][exact.start : exact.end] == items[3][1] and exact.edits == 0
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(df, bench).collect()) == [101, 102, 103]
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(corpus, bench.limit(0)).count() == 0
    a, b = np.array([[1, 2, 3, 4]], np.uint64), np.array([[1, 3, 4, 5]], np.uint64)
    assert decontamination.edit_distances(a, b, np.array([4]))[0] == 2


def test_decontamination_finds_every_window_within_reach(spark):
    """Against all windows' edit distances: items without their first or last words, edits at one place, and scattered ones."""
    rng = random.Random(6)
    search = decontamination.Search()
    items = [words(rng, n, 4000).split() for n in (15, 40, 40, 120, 300)]
    docs = []
    for own in items:
        n, d = len(own), search.reach(len(own))
        for cut in (d // 2, d // 2 + 1, d):
            more = words(rng, n, 4000).split()
            docs += [own[cut:] + more, more + own[: n - cut], own[: n // 2] + more[:cut] + own[n // 2 :], own[: n // 3] + own[n // 3 + cut :]]
        spots = rng.sample(range(n), d)
        docs += [[("other" if k in spots else x) for k, x in enumerate(own)]]
    items += [["zz"], ["yy"], ["zz", "yy"]]
    docs += [["zz"], ["a", "zz", "b", "yy"], ["a", "zz", "yy"], ["zzyy"]]

    def brute(doc, item):
        n = len(item)
        code = {x: k for k, x in enumerate({*doc, *item})}
        windows = [doc[k : k + n] for k in range(max(1, len(doc) - n + 1))]
        wide = np.array([[code[x] for x in w] + [-1] * (n - len(w)) for w in windows])
        least = decontamination.edit_distances(wide, np.array([[code[x] for x in item]]), np.array([len(w) for w in windows])).min()
        return int(least) if least <= search.reach(n) else None

    want = {(k, i, e) for k, doc in enumerate(docs) for i, item in enumerate(items) if (e := brute(doc, item)) is not None}
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in decontamination.contaminated(df, bench).collect()} == want and len(want) > 35


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def disclosed(rows, policy):
    """Terms by entity, from counts over all rows."""
    import math

    share = {"email": lambda v: v.split("@")[1], "ip": lambda v: ".".join(v.split(".")[:3]), "card": lambda v: v[:6], "phone": lambda v: v[:5]}
    value = {"email": str.lower, "ip": str, "card": lambda v: re.sub("[^0-9]", "", v), "phone": lambda v: "+" + re.sub("[^0-9]", "", v)}
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    n_e, n_t, n_te, texts, of = Counter(), Counter(), Counter(), {}, []
    for _, text in rows:
        spans = sorted((a, z, k) for k, a, z in base_spans(text))
        held, pairs = set(), set()
        for i, (a, z, k) in enumerate(spans):
            v = value[k](text[a:z])
            left = letters(text[spans[i - 1][1] if i else 0 : a])
            right = letters(text[z : spans[i + 1][0] if i + 1 < len(spans) else len(text)])
            own = {f"{k} {v}", f"{k} of {share[k](v)}"}
            held |= own
            pairs |= {(e, t) for e in own for t in left[::-1][: policy.window] + right[: policy.window]}
        of.append(held)
        n_e.update(held)
        n_t.update(set(letters(text)))
        n_te.update(pairs)
        for x in pairs:
            texts.setdefault(x, set()).add(text)
    n, out = len(rows), {}
    for (e, t), k in n_te.items():
        if len(texts[e, t]) >= policy.support and n_e[e] < n and math.log(k * n / (n_t[t] * n_e[e])) / math.log(n / n_e[e]) >= policy.generalise:
            out.setdefault(e, set()).add(t)
    return [set().union(*[out.get(e, set()) for e in held]) & set(letters(text)) for held, (_, text) in zip(of, rows, strict=True)]


def test_pii_terms_against_brute_force(spark):
    rng = random.Random(14)
    value = lambda k: [f"p{k}@mail{k % 5}.example.com", f"10.{k % 3}.{k}.7", f"+1{k} (555) 100-12{k:02d}"][k % 3]
    rows = []
    for i in range(150):
        ws = words(rng, 30, 60).translate(str.maketrans("0123456789", "ghijklmnop")).split()
        for _ in range(rng.randint(0, 3)):
            k, at = rng.randrange(14), rng.randrange(len(ws))
            ws[at:at] = [*rng.sample(["Zebra" if k < 2 else "Bär", f"Desk{'abcdefghijklmn'[k]}", "call"], 3), value(k)]
        rows.append((i, " ".join(ws)))
    rows += rows[:9]
    for policy in (pii.Policy(), pii.Policy(window=2, support=2, generalise=0.5, broadcast_terms=0)):
        got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), policy=policy).collect()
        want = disclosed(rows, policy)
        assert sorted((r.doc_id, sorted({s.value.lower() for s in r.spans if s.kind == "term"})) for r in got) == sorted((d, sorted(t)) for (d, _), t in zip(rows, want, strict=True))
        assert any(want)


def test_pii(spark, corpus, empty):
    rng = random.Random(3)
    odd = ["a@b.c-_x@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111-4111", "+1 (555) 123-4567 +1+22 333 444 55", "1 " * 4000 + "a@" + "b." * 4000 + "c", "9" * 20000, "@. ab@c.d"]
    odd += ["".join(rng.choice("ab1.@+- 0()45_é%\n") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(odd, 1000)), "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    texts = dict(df.collect())
    got = pii.sanitise(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == base_spans(texts[r.doc_id])
    # a word that stands by one value only, in several different places, gives it away; a common one does not
    near = [(i, f"{words(rng, 40)} codename of the zebra{'' if i < 6 else 'x'} {'' if i > 5 else 'me@corp.example.com'} {words(rng, 3)}") for i in range(12)]
    near += [(i + 30, f"{words(rng, 20)} codename of the thing {words(rng, 9)}") for i in range(20)]
    plain = [(i + 50, words(rng, 60)) for i in range(60)]
    r = {x.doc_id: x for x in pii.sanitise(spark.createDataFrame(near + plain, "doc_id long, text string")).collect()}
    assert {s.value for s in r[0].spans if s.kind == "term"} == {"zebra"} and "zebra" not in r[0].sanitised and "[EMAIL]" in r[0].sanitised
    assert r[8].sanitised == near[8][1]
    done = pii.sanitised_documents(corpus)
    assert done.columns == corpus.columns and done.count() == corpus.count()
    assert pii.sanitise(empty).count() == 0


def test_packing(spark, corpus, empty):
    plan = packing.Plan(public_tokenizers.path("byte_bpe_50k.json"), window=256, group_pieces=64)
    library = TokenIds(plan.tokenizer)
    rows, texts = packing.packed_documents(corpus, plan).collect(), {r.doc_id: r.text for r in corpus.collect()}
    by, ids = {}, {d: [*np.frombuffer(library.whole(t or ""), "<u4").tolist(), 1] for d, t in texts.items()}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    times = corpus.groupBy("doc_id").count().collect()
    for d, n in times:
        assert sum(r.length for r in rows if r.doc_id == d) == n * len(ids[d])
    assert packing.packed_documents(empty, plan).count() == 0
    levels, rng = packing.Levels(50), random.Random(2)
    for _ in range(300):  # each placing makes the sum of squares least
        size, n = rng.randint(1, 50), levels.count.copy()
        choices = [0] + [h for h in range(1, 51 - size) if n[h]]
        def after(h, n=n, size=size):
            m = n.copy()
            m[h] -= h > 0
            if h + size < 50:
                m[h + size] += 1
            return int((m[1:50] ** 2).sum())
        _, offset = levels.place(size)
        assert after(offset) == min(map(after, choices))


def test_token_ids_equal_the_library():
    rng, t = random.Random(1), TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [*"ab 's1\n\té \x85\xa0\x1c\0.!<|", "  ", "\n\n", " \n", "<|endoftext|>", "don't", "日本", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [" " * 1_000_000, " \t" * 400_000 + "y", "a" * 300_000, "".join(map(chr, range(1, 0x3000))), "x<|endoftext|> y<|endoftext|>"]
    assert [t.ids(x) for x in texts] == [t.whole(x) for x in texts]


def test_token_counts(spark, corpus, empty):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library, t = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.Transducer.of_model(model)
    rng = random.Random(2)
    parts = [*"abcdethion 's1\n\té▁日本.!<|0\0", "  ", "   ", " \n", "</s>", "the", "tion", "<0x0A>", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    want = [len(x) for x in library.encode(texts)]
    for chunk in (1, 3, 1 << 16):
        assert [t.total(x, chunk) for x in texts] == want
    for r in token_counts.token_counts(corpus, model, limit=100).join(corpus.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(library.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)
    assert token_counts.token_counts(empty, model).count() == 0


def test_token_counts_of_texts_split_over_tasks(spark):
    """Chunks as rows, with and without blanks, where the lead is too short to tell the state, against the library."""
    import sentencepiece

    model, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(4)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [words(rng, 300), "".join(rng.choice("abcdethion日") for _ in range(900)), " " * 400, "a" * 700, "▁" * 50 + "the  end\n" * 60, "", None, "x", words(rng, 300)]
    texts += ["internationalization" * 20, "<0x0A></s>" * 40]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, row int, chunk string")
    for chunk, lead in ((40, 8), (37, 0), (400, 256)):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, model, chunk=chunk, lead=lead).collect()}
        assert got == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}


def test_sharding(spark, corpus, empty, tmp_path):
    rows = sharding.sharded(corpus, 5, bucket_bytes=2000).collect()
    assert Counter(tuple(r)[:-2] for r in rows) == Counter(map(tuple, corpus.collect()))
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 5) < 1
    again = sharding.sharded(corpus, 5, bucket_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    other = sharding.sharded(corpus, 5, seed=1, bucket_bytes=2000).collect()
    assert sorted(map(str, other)) != sorted(map(str, rows))
    assert sharding.sharded(empty, 5).count() == 0
    assert sorted(sharding.fisher_yates(100, np.random.default_rng(1)).tolist()) == list(range(100))
    sharding.write_shards(corpus, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == corpus.count()


def test_language_id(spark, empty):
    rng = random.Random(7)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, make("abcdef" if i % 2 else "defghé"), "x" if i % 2 else "y") for i in range(200)]
    odd = [(900, None, "x"), (901, "12 34", "y"), (902, "", None), (903, "a" * 50000, None), (903, "a" * 50000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    train = df.filter(language_id.remainder(F.col("doc_id")) != 2)
    got = {r.doc_id: r for r in language_id.languages(df.select("doc_id", "text"), train).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.98
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.languages(empty.select("doc_id", "text"), empty).count() == 0
    many = spark.createDataFrame([(i, make("abcdefgh"), f"l{i % 400}") for i in range(1200)], "doc_id long, text string, lang string")
    few = language_id.Settings(fit_rows=300, landmarks=32)
    assert len(set(language_id.examples(many, few)[1])) == 400 and language_id.languages(many.select("doc_id", "text"), many, few).filter("lang_pred LIKE 'l%'").count() == 1200
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.languages(df.select("doc_id", "text"), unlabelled).collect()} == {"und"}


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://m.Example.NET/en/1", "http://example.com/de/", "http://x.org/fr/a?b#c", "http://x.net", None, "no host", "HTTP://B.example.net?q=1", "ftp://net/en/"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://h{i % 7}.example.com/{'bad' if i % 2 else 'good'}/p{i}?k=1") for i in range(200)]
    labels = [(100 + i, int(i % 2 == 0), 0) for i in range(100)] + [(100, 1, None)]
    df, told = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(df, told).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(9)] == [
        ("a.net", "/x", "net/", "block"), ("m.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/a", "org/fr/", "allow"),
        ("x.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.example.net", "", None, "allow"), ("net", "/en/", "net/", "block"),
    ]
    assert all(got[100 + i].verdict == ("block" if i % 2 else "allow") for i in range(200))
    assert {r.verdict for r in url_rules.judge(df, told.limit(0)).filter("page_id >= 100").collect()} == {"allow"}
    assert url_rules.judge(df.limit(0), told).count() == 0


def test_url_rules_against_all_sets(spark):
    """Mined rules against every set of tokens of the bad pages; labels by chance give none."""
    import math
    from itertools import combinations

    rng = random.Random(21)
    urls = [f"http://{rng.choice(['a', 'b', 'www'])}.{rng.choice(['one', 'two', 'three'])}.{rng.choice(['com', 'net'])}/{rng.choice(['x', 'y', 'z'])}/{i}{rng.choice(['', '.html', '?k=1', '#top'])}" for i in range(600)]
    urls += ["http://a.one.net/" + "long/" * 3000 + "x/7?k=1"] * 2
    bad = [("net/x" in u.replace("one.", "").replace("two.", "").replace("three.", "") and rng.random() < 0.8) or rng.random() < 0.1 for u in urls]
    pages = spark.createDataFrame([(i, u, "v", 1) for i, u in enumerate(urls)], "page_id long, url string, tokens string, id int")
    sets = []
    for u in urls:
        host, _, path = u[7:].partition("/")
        rest = re.search(r"(\?k)|(#top)", path)
        ends = {"host:" + ".".join(host.split(".")[-k:]) for k in (1, 2, 3)}
        path = re.split(r"[?#]", "/" + path)[0].split("/")
        others = {"path:" + re.sub("[0-9]+", "0", re.sub(r"\.html$", "", p)) for p in path if p} | ({"ext:html"} if u.endswith(".html") else set()) | ({{"?k": "query:k", "#top": "fragment:top"}[rest[0]]} if rest else set())
        sets.append((ends, others))

    def all_rules(labels, m):
        count, of_bad = {}, {}
        for (ends, others), b in zip(sets, labels):
            for own in [(), *[(e,) for e in ends]]:
                for n in range(len(others) + 1):
                    for more in combinations(sorted(others), n):
                        if key := frozenset(own + more):
                            count[key] = count.get(key, 0) + 1
                            of_bad[key] = of_bad.get(key, 0) + b
        base, n_bad = sum(labels) / len(labels), sum(labels)
        # what is tried: the sets that are frequent among the views of bad pages, those without ending once in each view
        views = {k: v if any(t.startswith("host:") for t in k) else 4 * v for k, v in of_bad.items()}
        tried = sum(v >= max(m.min_bad, m.min_support * n_bad) for v in views.values())

        def sure(k):
            p = of_bad[k] / count[k]
            if of_bad[k] < max(m.min_bad, m.min_support * n_bad) or p < m.min_lift * base or p <= base:
                return False
            return count[k] * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)) > -math.log(m.alpha / tried)

        good = {k: of_bad[k] / count[k] for k in count if sure(k)}
        return {k for k, p in good.items() if not any(o < k and q >= p for o, q in good.items())}

    mining = url_rules.Mining()
    for labels in (bad, [rng.random() < 0.25 for _ in urls]):
        told = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(labels)], "doc_id long, quality int, toxic int")
        want = all_rules(labels, mining)
        hit = [sum(k <= ends | others for k in want) for ends, others in sets]
        got = {r.page_id: r for r in url_rules.judge(pages, told, rules=(), mining=mining).collect()}
        assert [got[i].n_rules for i in range(len(urls))] == hit and [got[i].verdict for i in range(len(urls))] == ["block" if h else "allow" for h in hit]
        assert bool(want) == (labels is bad)


CLASHES = ["TEXT", "_source", "_row", "_barrier", "_times", "_key", "_id", "_0", "bucket", "at", "rank", "before", "shard", "slot", "node", "key", "component", "failed", "words", "n_words", "tokens", "id", "host", "candidate", "label", "features", "lead", "chunk", "_text", "value"]


def test_columns_that_clash(spark):
    """No operator minds columns named like its own, or like the text but for the case; rows come back with them."""
    rng = random.Random(2)
    rows = [(i, words(rng, 80, 3000), "en") for i in range(6)] + [(None, None, None), (0, "same " * 60, "en")]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{x}` string" for x in CLASHES)
    df = spark.createDataFrame([r + ("x",) * len(CLASHES) for r in rows], schema)
    bench = spark.createDataFrame([(1, rows[2][1], "x", "y")], "item_id long, text string, TEXT string, _n string")
    names = df.columns
    for got, n in ((quality_rules.keep_good(df), 6), (jaccard_join.keep_one(df), 8), (decontamination.drop_contaminated(df, bench), 7), (pii.sanitised_documents(df), 8)):
        assert got.columns == names and got.count() == n and {tuple(r)[3:] for r in got.collect()} == {("x",) * len(CLASHES)}
    assert quality_rules.judge(df).filter("kept").count() == 6 and jaccard_join.near_duplicates(df).count() == 8 and decontamination.contaminated(df, bench).count() == 1
    got = sharding.sharded(df, 3)
    assert got.columns == [f"{x}_" if x in ("shard", "slot") else x for x in names] + ["shard", "slot"] and got.count() == 8
    plan = packing.Plan(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.packed_documents(df, plan).count() == 8 and token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 8
    assert secret_scan.scan(df).count() == 0 and pii.sanitise(df).count() == 8
    pages = df.toDF("page_id", "url", *names[2:])
    assert url_rules.judge(pages, df.toDF("doc_id", "quality", "toxic", *names[3:]).limit(0)).count() == 8


def test_judge_stands_below_filters(spark):
    """A filter on a verdict does not multiply the statistics below it."""
    df = spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")
    judged = quality_rules.judge(df)
    for cond in ("kept", "failed_rule = 'x'", "n_words > 3", "base_failed OR kept"):
        plan = judged.filter(cond).select("doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") <= 2 and len(plan) < 20_000


def test_cascade_order():
    """By rejections per cost among the rows that are left."""
    rules = tuple(quality_rules.Rule(x, "true") for x in "abc")
    # a rejects most but is dear; b rejects the same rows cheaply; c others
    got = quality_rules.by_rank(rules, [1.0, 0.25, 0.5], [(0b011, 40), (0b100, 10), (0, 50)])
    assert [m.rule.name for m in got] == ["b", "c", "a"] and [m.rejects for m in got] == [0.4, 10 / 60, 0.0]


def test_secret_scan_candidates_and_labels(spark):
    """Values of any kind behind a credential name; the forest goes against labels that are wrong or missing."""
    rng = random.Random(18)
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    card = lambda: "4111111111111111"
    texts = [f'{words(rng, 8)} token = "{key()}" {words(rng, 5)}' if i % 2 else f"{words(rng, 8)} {rng.randrange(10**15, 10**16)} {words(rng, 5)}" for i in range(160)]
    odd = {
        "assigned card": f'{words(rng, 8)} token = "{card()}" end', "bare key": f"{words(rng, 8)} {key()} end", "pass phrase": 'my password: "Tr0ub4dor & co!" end', "short": "pwd=a1!x end",
        "letters": f"see {'aBcDeFgHiJkLmNoPqRsT'} end", "plain word": "see Zusammenstellung here", "path": "see src/main/java/util1/name2 end",
    }
    rows = [*enumerate(texts), *enumerate(odd.values(), 1000), (1000, odd["assigned card"])]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {n: [r for r in got if r.doc_id == 1000 + i] for i, n in enumerate(odd)}
    assert [r.candidate for n in ("pass phrase", "short", "letters") for r in by[n]] == ["Tr0ub4dor & co!", "a1!x", "aBcDeFgHiJkLmNoPqRsT"] and not by["plain word"]
    assert len(by["assigned card"]) == 2 and all(r.named and not r.secret for r in by["assigned card"])
    assert all(not r.named and r.secret for r in by["bare key"]) and len(by["bare key"]) == 1
    assert all(dict(rows)[r.doc_id][r.start : r.end] == r.candidate for r in got)


def test_secret_scan(spark, empty):
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{words(rng, 8)} token = "{key()}" end' if i % 2 else f"{words(rng, 8)} {rng.randrange(10**15, 10**16)} end" for i in range(120)]
    df = spark.createDataFrame([*enumerate(texts), (500, None), (501, ""), (502, "9a" * 9000)], "doc_id long, text string")
    rows = secret_scan.scan(df).collect()
    assert all(r.secret == (r.doc_id % 2 == 1) for r in rows if r.doc_id < 500) and len([r for r in rows if r.doc_id < 500]) == 120
    assert all(texts[r.doc_id][r.start : r.end] == r.candidate for r in rows if r.doc_id < 500)
    assert secret_scan.scan(empty.select("doc_id", "text")).count() == 0
    told = spark.createDataFrame([("see ", key(), 1) for _ in range(30)] + [("see ", str(rng.randrange(10**15, 10**16)), 0) for _ in range(30)], "before string, candidate string, label int")
    assert {r.secret for r in secret_scan.scan(df, told).filter("doc_id % 2 = 1 AND doc_id < 500").collect()} == {True}


def good_text(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    repeats = len({i + k for i, g in enumerate(grams) if g in twice for k in range(3)})
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, letter = sum(map(len, ws)), lambda w: any(unicodedata.category(c)[0] == "L" for c in w)
    return (
        len(ws) >= 50 and 100 * repeats <= 50 * len(ws) and 3 * len(ws) <= chars <= 10 * len(ws) and 10 * sum(c in "#*$%&|<>" for c in text) <= len(ws)
        and 2 * (len(lines) - len(set(lines))) <= len(lines) and 10 * sum("A" <= c <= "Z" for c in text) <= 3 * chars and 10 * sum(map(letter, ws)) >= 8 * len(ws)
    )


def sanitised(rows, policy):
    """The texts with [KIND] for spans and terms, and strong terms gone."""
    strong = disclosed(rows, replace(policy, generalise=policy.remove))
    out = []
    for (_, text), terms, gone in zip(rows, disclosed(rows, policy), strong, strict=True):
        marks = [(a, z, f"[{k.upper()}]") for k, a, z in base_spans(text)]
        if terms:
            for m in re.finditer(r"(?<![^\W\d_])(?:" + "|".join(sorted(terms)) + r")(?![^\W\d_])", text, re.I):
                marks.append((m.start(), m.end(), "" if m.group().lower() in gone else "[TERM]"))
        at, parts = 0, []
        for a, z, by in sorted(marks):
            if a >= at:
                parts += [text[at:a], by]
                at = z
        out.append("".join([*parts, text[at:]]))
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_against_brute_force(spark):
    """Which documents stay, their texts, and every piece, by plain Python from the tables."""
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    good = {d: t for d, t in docs.items() if good_text(t)}
    heads = {d for d, c, _ in jaccard_classes(sorted(good.items())) if d == c}
    items = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = lambda t: any(" ".join(i) in " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())) for i in items)
    left = [(d, good[d]) for d in sorted(heads) if not held(good[d])]
    library = TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: library.whole(t) + b"\1\0\0\0" for (d, _), t in zip(left, sanitised(left, pii.Policy()), strict=True)}
    got, windows = corpus_pipeline.run(spark, DATA).collect(), {}
    assert {r.doc_id for r in got} == set(want) and any(b != library.whole(good[d]) + b"\1\0\0\0" for d, b in want.items())
    for r in got:
        assert 4 * r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, b in want.items():
        pieces = sorted((r.start, r.length) for r in got if r.doc_id == d)
        assert [x for x, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and 4 * sum(n for _, n in pieces) == len(b)
    for own in windows.values():
        assert sum(n for _, n in own) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))


def test_pipeline_of_odd_tables(spark, corpus, empty, tmp_path):
    """Null, empty, long and repeated rows, and no rows at all, go through every stage."""
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "never to be found anywhere in these tables")], "item_id long, text string")
    good = {r.doc_id for r in corpus.collect() if good_text(r.text)}
    for name, df in (("odd", corpus), ("none", empty)):
        df.select(columns).coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in rows} <= good and bool(rows) == (name == "odd")
    docs = empty.select(columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path / "none")).columns == columns


@pytest.mark.parametrize("k", [4, 13, 30])
def test_url_tokens_that_say_the_same(spark, k):
    """Six bad pages that share k query keys: one rule, whatever k is, and any of the keys matches it."""
    keys = "&".join(f"k{chr(97 + i % 26)}{'x' * (i // 26)}=1" for i in range(k))
    urls = [f"http://h{i}.site{i}.com/p{i}?{keys}" for i in range(6)] + [f"http://h{i}.site{i}.com/p{i}/q" for i in range(60)] + ["http://new.com/?kb=7&other=1", "http://new.com/?other=1", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    told = spark.createDataFrame([(i, int(i >= 6), 0) for i in range(66)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(pages, told, rules=()).collect()}
    assert [i for i in range(69) if got[i].verdict == "block"] == [0, 1, 2, 3, 4, 5, 66]
    assert {got[i].n_rules for i in (0, 5, 66)} == {1}


def test_quality_sample_is_drawn_by_all_tasks(spark):
    text = spark.range(0, 10_000, 1, 20).select(F.repeat(F.lit("word "), 60).alias("text"))
    sample = quality_rules.drawn(text, 0.05, 7)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange SinglePartition" in plan.replace("ShuffleExchange", "Exchange")
    assert sample.rdd.getNumPartitions() == 1 and 300 < sample.count() < 700
    shuffled = sample.rdd.toDebugString().decode()
    assert "(20)" in shuffled  # the scan's tasks


def plain_edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (x != y))
    return line[-1]


@pytest.mark.parametrize("n", [1, 2, 15, 63, 64, 65])
def test_edit_distances_by_bits_against_plain_python(n):
    rng = np.random.default_rng(n)
    b = rng.integers(0, 5, (300, n), np.uint64)
    a = b.copy()
    a[:, : n // 2] = np.roll(a, 1, axis=1)[:, : n // 2]
    a[100:, rng.integers(0, n)] = 9
    a[200:] = rng.integers(0, 5, (100, n))
    size = rng.integers(0, n + 1, 300)
    a[np.arange(n)[None, :] >= size[:, None]] = decontamination.PAD
    want = np.array([plain_edits(x[:k].tolist(), y.tolist()) for x, y, k in zip(a, b, size, strict=True)])
    assert (decontamination.edit_distances(a, b, size) == want).all()
    for most in (0, n // 5, n):
        got = decontamination.edit_distances(a, b, size, most)
        assert (np.minimum(got, most + 1) == np.minimum(want, most + 1)).all()


def test_rows_beyond_the_bound_are_given_up():
    """Pairs of nothing in common are left after as many words as edits are allowed, not compared to their end."""
    seen = []

    class Told(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, tuple) and isinstance(k[1], slice):
                seen.append(k[1].start)
            return super().__getitem__(k)

    a, b = np.full((10, 50), 1, np.uint64).view(Told), np.full((10, 50), 2, np.uint64)
    assert (decontamination.edit_distances(a, b, np.full(10, 50), 10) > 10).all() and max(seen) <= 11
