"""Files that arrive while a query runs, stops, fails and starts again: the counts are the batch run's."""

from __future__ import annotations

import json
import os
import random
from pathlib import Path

import pytest

from strandsort.options import Options
from strandsort.read_structure import ReadStructure
from strandsort.run import run
from strandsort.sources import bgzf, commit
from strandsort.streaming import arrivals
from tests.test_demux import read_fastq, sheet, tsv

REPORTS = ("metrics.tsv", "per_sample_metrics.tsv", "per_project_metrics.tsv", "most_frequent_unmatched.tsv")


def arrive(folder, lane, n, whole=True):
    """Both files of a lane; one that is not whole has no end block yet."""
    rng = random.Random(lane)
    seqs = ["".join(rng.choice(["AAAA", "CCCC", "AAAC", "GGGG"])) for _ in range(n)]
    for kind, seq in (("I1", lambda s: s), ("R1", lambda s: s + "ACGT")):
        data = "".join(f"@I:1:F:{lane}:1101:{i}:1 1:{'Y' if i % 7 == 0 else 'N'}:0:N\n{seq(s)}\n+\n{'I' * len(seq(s))}\n" for i, s in enumerate(seqs)).encode()
        with open(f"{folder}/p_L00{lane}_{kind}_001.fastq.gz", "wb") as out:
            for b in bgzf.compress(iter([data])):
                out.write(b)
            if whole or kind == "I1":
                out.write(bgzf.EOF)


def options(tmp_path, out):
    os.makedirs(tmp_path / out, exist_ok=True)
    path = sheet(tmp_path / "s.csv", ["a,AAAA", "b,CCCC"])
    return Options([str(tmp_path / "in")], path, [ReadStructure.parse("4B"), ReadStructure.parse("+T")], str(tmp_path / out), min_delta=1, filter_failing_quality=True)


def go_on(spark, tmp_path, **more):
    q = arrivals.follow(spark, options(tmp_path, "out"), str(tmp_path / "in"), ["R1", "I1"], str(tmp_path / "check"), records_per_task=50, availableNow=True, **more)
    q.awaitTermination(300)
    return q


def outputs(folder, name):
    return sorted(h for d in sorted(Path(folder).glob("batch-*")) for h, _, _ in read_fastq(d / name))


def same_as_batch(spark, tmp_path, out):
    """Reports and records of what has arrived equal those of one run over the same files."""
    run(spark, options(tmp_path, out))
    for name in REPORTS:
        assert tsv(tmp_path / "out" / name) == tsv(tmp_path / out / name), name
    for sample in ("a_S1", "b_S2", "Undetermined_S3"):
        name = f"{sample}_L001_R1_001.fastq.gz"
        assert outputs(tmp_path / "out", name) == sorted(h for h, _, _ in read_fastq(tmp_path / out / name))


def test_stop_fail_and_restart(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    arrive(tmp_path / "in", 1, 120)
    go_on(spark, tmp_path)
    same_as_batch(spark, tmp_path, "once")
    # a second lane arrives, a third is being written; the driver is lost after the outputs are staged and the state is kept
    arrive(tmp_path / "in", 2, 90)
    arrive(tmp_path / "in", 3, 40, whole=False)
    with monkeypatch.context() as m:
        m.setattr(commit.Job, "publish", lambda self, names: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            go_on(spark, tmp_path)
    assert not [p for p in os.listdir(tmp_path / "out/batch-000001") if not p.startswith(".")]
    # and once more after the outputs are published, before the reports are
    plain, calls = arrivals.R.write_reports, []
    with monkeypatch.context() as m:
        m.setattr(arrivals.R, "write_reports", lambda *a: calls.append(1) or (_ for _ in ()).throw(RuntimeError("lost again")))
        with pytest.raises(Exception, match="lost again"):
            go_on(spark, tmp_path)
    assert calls and plain is arrivals.R.write_reports
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out/batch-000001").glob("*.gz")}
    go_on(spark, tmp_path)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out/batch-000001").glob("*.gz")} == before  # published once
    third = {k: (tmp_path / "in" / f"p_L003_{k}_001.fastq.gz") for k in ("R1", "I1")}
    held = {k: p.read_bytes() for k, p in third.items()}
    for p in third.values():
        p.unlink()
    same_as_batch(spark, tmp_path, "twice")
    for k, p in third.items():
        p.write_bytes(held[k] + (bgzf.EOF if k == "R1" else b""))
    go_on(spark, tmp_path)
    same_as_batch(spark, tmp_path, "thrice")
    assert sorted(p.name for p in (tmp_path / "out").glob("batch-*")) == [f"batch-00000{i}" for i in range(3)]
    assert not [p for p in (tmp_path / "out").rglob(".run-*")]
    go_on(spark, tmp_path)  # nothing new
    assert json.loads((tmp_path / "check/arrivals/000000002").read_text())["lane"] == 3


def test_offsets_and_bounded_batches(tmp_path):
    (tmp_path / "in").mkdir()
    for lane in (1, 2, 3):
        arrive(tmp_path / "in", lane, 2)
    reader = lambda: arrivals.ArrivalReader({"folder": str(tmp_path / "in"), "log": str(tmp_path / "log"), "groups": '["R1", "I1"]', "maxsets": "2"})
    first = reader()
    assert first.initialOffset() == {"sets": 0} and first.latestOffset() == {"sets": 2}
    rows = [r for p in first.partitions({"sets": 0}, {"sets": 2}) for r in first.read(p)]
    assert [(r[0], r[2], [Path(f).name for f in r[3]]) for r in rows] == [(0, 1, ["p_L001_I1_001.fastq.gz", "p_L001_R1_001.fastq.gz"]), (1, 2, ["p_L002_I1_001.fastq.gz", "p_L002_R1_001.fastq.gz"])]
    again = reader()  # a new driver
    assert [r for p in again.partitions({"sets": 0}, {"sets": 2}) for r in again.read(p)] == rows
    assert again.latestOffset() == {"sets": 3} == again.latestOffset()
    with pytest.raises(ValueError, match="Not a group"):
        arrivals.in_order(["R1", "X1"])
