"""Sketches of frequent values and partial states of metrics: bounds, merges, and lanes that are written again."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandsort import samples as S
from strandsort.operators import heavy_hitters as H
from strandsort.operators import metrics as R
from strandsort.operators import partial_metrics as P
from strandsort.plans.demux import Demultiplexer, Rules
from strandsort.read_structure import ReadStructure


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_through_merges(seed):
    """Sketches of parts, merged in any order and shape, bound every true count, and miss no frequent value."""
    rng = random.Random(seed)
    size = rng.choice([1, 3, 10])
    parts = [[f"v{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randrange(0, 400))] for _ in range(9)]
    sketches = []
    for part in parts:
        held, counts, error = pa.array([], pa.string()), np.zeros(0, np.int64), 0
        for k in range(0, len(part), 37):
            c = Counter(part[k : k + 37])
            held, counts, taken = H.cut_down(*H.added([(held, counts), (pa.array(list(c)), np.array(list(c.values())))]), size)
            error += taken
        sketches.append((held, counts, error))
    while len(sketches) > 1:
        (a, m, e), (b, n, f) = sketches.pop(rng.randrange(len(sketches))), sketches.pop(rng.randrange(len(sketches)))
        v, left, taken = H.cut_down(*H.added([(a, m), (b, n)]), size)
        sketches.append((v, left, e + f + taken))
    (values, counts, error), true = sketches[0], Counter(x for p in parts for x in p)
    total, found = sum(true.values()), dict(zip(values.to_pylist(), counts.tolist()))
    assert len(found) <= size and error * (size + 1) <= total
    assert all(found.get(v, 0) <= n <= found.get(v, 0) + error for v, n in true.items())
    assert all(v in found for v, n in true.items() if n * (size + 1) > total)


def test_frequent_values_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN_IN", 3)  # several rounds
    rng = random.Random(1)
    values = [None if rng.random() < 0.1 else f"b{min(int(rng.expovariate(0.05)), 200)}" for _ in range(5000)] + ["hot"] * 2500
    df = spark.createDataFrame([(v,) for v in values], "x string").repartition(20)
    true = Counter(v for v in values if v is not None)
    total = sum(true.values())
    bounds = H.frequent(df, 25).collect()
    assert len(bounds) <= 25 and all(r["rows"] == total and r["at_least"] <= true[r["value"]] <= r["at_most"] for r in bounds)
    assert all((r["at_most"] - r["at_least"]) * 26 <= total for r in bounds)
    exact = {r["value"]: r["n"] for r in H.frequent_exact(df, 25).collect()}
    assert exact == {v: n for v, n in true.items() if n * 26 > total} and "hot" in exact
    assert H.frequent(df.limit(0), 25).count() == 0
    assert H.frequent_exact(df.filter("x IS NULL"), 25).count() == 0


SCHEMA = "head_0 string, seq_0 string, qual_0 string"


def lane_reads(seed, n):
    rng = random.Random(seed)
    head = lambda i: f"I:1:F:{seed}:1101:{i}:1 1:{rng.choice('NNNY')}:{rng.choice('0001')}:N"
    return [(head(i), rng.choice(["AAAA", "AAAT", "CCCC", "GGGG", "NNNN"]) + "ACGTA", "".join(rng.choice("#5?I") for _ in range(9))) for i in range(n)]


def test_states_of_lanes_are_one_run(spark, tmp_path):
    samples = [S.Sample("a", barcode="AAAA"), S.Sample("b", barcode="CCCC", ordinal=1), S.Sample("u", barcode="NNNN", ordinal=2)]
    plan = Demultiplexer(samples, [ReadStructure.parse("4B+T")], ["T"], Rules(filter_failing_quality=True, filter_control_reads=True))
    lanes = {"L1": lane_reads(1, 200), "L.2/x": lane_reads(2, 150), "L3": lane_reads(3, 1)}
    frames = {k: spark.createDataFrame(v, SCHEMA) for k, v in lanes.items()}
    folder = str(tmp_path / "states")
    assert_empty = P.report_rows(plan, spark.createDataFrame([], P.SCHEMA))
    assert R.run_counts(assert_empty[0]).first()["total_templates"] == 0
    P.save(P.state_of(plan, frames["L3"]), folder, "L1")  # a first try with other reads
    for lane, frame in frames.items():
        P.save(P.state_of(plan, frame), folder, lane)
    (tmp_path / "states/lanes/L9.half").write_text("{")  # a pointer that was being written
    assert sorted(P.lanes(folder)) == sorted(lanes)
    whole = spark.createDataFrame([r for v in lanes.values() for r in v], SCHEMA)
    told = plan.with_drop_reason(plan.checked(whole)).cache()
    totals, rows = P.report_rows(plan, P.merged(spark, folder))
    assert R.run_counts(totals).collect() == R.run_counts(told).collect()
    one = plan.report_rows(whole)
    same = lambda f: sorted(map(str, f(rows).collect())) == sorted(map(str, f(one).collect()))
    assert same(R.per_sample_counts) and same(R.unmatched_counts)
    # some lanes only, and other rules, without the reads
    strict = Demultiplexer(samples, plan.structures, ["T"], Rules(allowed_mismatches=0, filter_failing_quality=True, filter_control_reads=True))
    some = P.report_rows(strict, P.merged(spark, folder, ["L.2/x"]))[1]
    assert sorted(map(str, R.per_sample_counts(some).collect())) == sorted(map(str, R.per_sample_counts(strict.report_rows(frames["L.2/x"])).collect()))
    told.unpersist()
