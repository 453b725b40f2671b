"""Sheets of many samples: matching and checking by blocks, against all distances."""

from __future__ import annotations

import random
import time

import pytest

from strandsort import samples as S
from strandsort.operators import pigeonhole
from strandsort.operators.matching import MatcherKind, decided, decided_in_batches, with_match


def sheet_of(rng, n, length):
    """Random barcodes, some of which differ from another in one or two bases, and two that are equal."""
    out = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(n)]
    for i in range(0, n // 2, 2):
        near = list(out[i])
        for _ in range(2):
            near[rng.randrange(length)] = rng.choice("ACGT")
        out[i + 1] = "".join(near)
    out[5] = out[7]
    return out


def rows(df):
    return sorted(map(str, [(r.bc, r.sample_ordinal, r.hamming_dist) for r in df.collect()]))


@pytest.mark.parametrize(("kind", "length", "rule"), [(MatcherKind.CACHED, 16, (1, 2, 1)), (MatcherKind.CACHED, 9, (3, 1, 2)), (MatcherKind.PRECOMPUTE, 16, (1, 2, 1)), (MatcherKind.PRECOMPUTE, 7, (3, 1, 0)), (MatcherKind.PRECOMPUTE, 7, (0, 0, 0))])
def test_blocks_against_all_distances(spark, kind, length, rule):
    rng = random.Random(length)
    expected = sheet_of(rng, 150, length)
    seen = expected[:40] + ["".join(rng.choice("ACGTN") if rng.random() < 0.12 else c for c in rng.choice(expected)) + rng.choice(["", "", "A"]) for _ in range(250)]
    seen += ["", "ACGT", None, "acgt" * 4, expected[3][:-1], "N" * length, *[expected[0]] * 30]
    df = spark.createDataFrame([(x,) for x in seen], "bc string").coalesce(2)
    want = rows(decided_in_batches(df, "bc", expected, kind, *rule))
    assert rows(with_match(df, "bc", expected, kind, *rule)) == want
    assert sum("None, None" not in x for x in want) > 20
    sheet = spark.createDataFrame([(b, i) for i, b in enumerate(expected)], "barcode string, sample_ordinal int")
    assert rows(with_match(df.filter("length(bc) > 8"), "bc", sheet, kind, *rule)) == [x for x in want if len(x.split("'")[1] if "'" in x else "") > 8]


def test_matches_need_one_shuffle_of_barcodes(spark):
    """The index is broadcast, and all that follows stays where the distinct barcodes are: nothing is compared with all samples."""
    rng = random.Random(2)
    sheet = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(15)), i) for i in range(500)], "barcode string, sample_ordinal int")
    seen = sheet.selectExpr("barcode AS bc").distinct()
    plan = pigeonhole.matches(seen, sheet, MatcherKind.CACHED, 1, 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning(bc") == 1


def test_sheets_of_unequal_or_no_barcodes(spark):
    seen = spark.createDataFrame([("ACGT",)], "bc string")
    uneven = spark.createDataFrame([("ACGT", 0), ("ACG", 1)], "barcode string, sample_ordinal int")
    with pytest.raises(ValueError, match="same length"):
        pigeonhole.matches(seen, uneven, MatcherKind.CACHED, 1, 1, 1)
    assert pigeonhole.matches(seen, uneven.limit(0), MatcherKind.CACHED, 1, 1, 1).count() == 0
    assert pigeonhole.first_violation(uneven.limit(0), 1, 1).count() == 0
    assert rows(with_match(seen, "bc", uneven.limit(1), MatcherKind.CACHED, 1, 2, 1)) == ["('ACGT', 0, 0)"]


def first_by_all_pairs(barcodes, m, delta):
    for i, a in enumerate(barcodes):
        for j in range(i + 1, len(barcodes)):
            b = barcodes[j]
            if len(a) != len(b):
                return i, j, None, "length"
            if (d := S.hamming(a, b)) < m or d <= delta:
                return i, j, d, "collision" if d < m else "delta"
    return None


def test_first_violation_against_all_pairs(spark):
    rng = random.Random(5)
    for n, length, odd, rule in ((60, 8, None, (1, 2)), (60, 12, None, (2, 0)), (40, 12, 30, (1, 1)), (40, 14, 3, (0, 3)), (30, 20, None, (1, 2)), (30, 3, None, (5, 4)), (20, 15, 1, (1, -1)), (20, 15, None, (0, -1))):
        codes = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(n)]
        if odd is not None:
            codes[odd] += "A"
        want = first_by_all_pairs(codes, *rule)
        sheet = spark.createDataFrame([(b, i) for i, b in enumerate(codes)], "barcode string, sample_ordinal int").repartition(3)
        got = pigeonhole.first_violation(sheet, *rule).collect()
        assert [tuple(r) for r in got] == ([] if want is None else [want]), (n, length, rule)
        # the driver's check of a parsed sheet finds the same pair
        listed = [S.Sample(f"s{i}", barcode=b, ordinal=i) for i, b in enumerate(codes)]
        if want is None:
            S.check_barcode_pairs(listed, *rule)
        else:
            kinds = {"length": S.UnequalBarcodeLengths, "collision": S.BarcodeCollision, "delta": S.MinDeltaTooHigh}
            with pytest.raises(kinds[want[3]], match=rf"\bs{want[0]} and s{want[1]}\b"):
                S.check_barcode_pairs(listed, *rule)


def test_a_sheet_of_ten_thousand_is_checked_in_seconds():
    rng = random.Random(6)
    codes = {"".join(rng.choice("ACGT") for _ in range(24)) for _ in range(10_000)}
    listed = [S.Sample(f"s{i}", barcode=b, ordinal=i) for i, b in enumerate(sorted(codes))]
    began = time.perf_counter()
    S.check_barcode_pairs(listed, 1, 2)
    assert time.perf_counter() - began < 10


def test_broadcasts_are_counted_not_estimated(spark, tmp_path, monkeypatch):
    """The optimiser takes an index for as small as the file that its barcodes come from; beyond the bound nothing is broadcast. The results are the same."""
    rng = random.Random(8)
    expected = sheet_of(rng, 400, 15)
    spark.createDataFrame([(b, i) for i, b in enumerate(expected)], "barcode string, sample_ordinal int").write.parquet(f"{tmp_path}/sheet")
    sheet = spark.read.parquet(f"{tmp_path}/sheet")
    seen = spark.createDataFrame([(b[:k] + "N" + b[k + 1 :],) for b in expected for k in (0, 7)] + [(b,) for b in expected], "bc string")
    want = rows(with_match(seen, "bc", expected, MatcherKind.CACHED, 1, 2, 1))
    monkeypatch.setattr(pigeonhole, "BROADCAST_ROWS", 0)
    plan = pigeonhole.matches(seen.distinct(), sheet, MatcherKind.CACHED, 1, 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert rows(with_match(seen, "bc", sheet, MatcherKind.CACHED, 1, 2, 1)) == want


@pytest.mark.parametrize(("length", "radius"), [(12, 3), (15, 4), (15, 0), (7, 6), (5, 5), (0, 1)])
@pytest.mark.parametrize("n", [0, 1000, 10**6, 10**9])
def test_barcodes_within_the_radius_share_a_key(length, radius, n):
    rng, keys = random.Random(length), pigeonhole.blocks(length, radius, n)
    assert len(keys) <= pigeonhole.MOST_KEYS
    for _ in range(50):
        wrong = set(rng.sample(range(1, length + 1), min(length, radius)))
        assert any(not wrong & {b for at, size in key for b in range(at, at + size)} for key in keys)


def test_keys_grow_with_the_sheet():
    """Pairs by chance of 12 bases and three mismatches: blocks of three bases have 64 values whatever the sheet, and so pairs grow with its square."""
    pairs = lambda n: sum(n * n / 4.0 ** sum(size for _, size in key) for key in pigeonhole.blocks(12, 3, n))
    assert pairs(900_000) < 3000 * 900_000 and pairs(900_000) < 4 * 900_000**2 / 64 / 20


def test_first_violation_with_copies_and_behind_the_first_samples(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(pigeonhole, "FIRST_SAMPLES", 2)
    for bound in (0, 100_000):
        monkeypatch.setattr(pigeonhole, "BROADCAST_ROWS", bound)
        codes = ["".join(rng.choice("ACGT") for _ in range(24)) for _ in range(60)]
        for far, near in ((52, None), (52, 41), (30, 41)):
            codes[58] = codes[far]
            if near:
                codes[57] = codes[near][:-1] + ("A" if codes[near][-1] != "A" else "C")
            sheet = spark.createDataFrame([(b, i) for i, b in enumerate(codes)], "barcode string, sample_ordinal int")
            assert [tuple(r) for r in pigeonhole.first_violation(sheet, 1, 1).collect()] == [first_by_all_pairs(codes, 1, 1)]
            codes[58] = "".join(rng.choice("ACGT") for _ in range(24))


def test_the_barcode_is_put_as_bits_once_a_row(spark):
    """And no column for each sample: the code generated for a row was too long to be compiled."""
    rng = random.Random(10)
    expected = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(60)]
    df = decided(spark.createDataFrame([(b,) for b in expected] + [(None,), ("",)], "bc string"), "bc", expected, MatcherKind.CACHED, 1, 2, 1)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2 and plan.count("bit_count") == 2  # two words of bits
    assert rows(df) == sorted(map(str, [*[(b, i, 0) for i, b in enumerate(expected)], (None, None, None), ("", None, None)]))
