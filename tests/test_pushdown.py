"""Filters inside the source: it drops the templates, and the counts of what is dropped stay."""

from __future__ import annotations

import json

import pytest

from strandsort.options import Options
from strandsort.read_structure import ReadStructure
from strandsort.run import run
from strandsort.sources import fastq
from tests.test_demux import HEAD, read_fastq, sheet, tsv, write_fastq

KINDS = [("N", "0"), ("Y", "0"), ("N", "2"), ("Y", "18"), ("N", "00")]


def files(tmp_path, n=40):
    """Two FASTQs; a template's flags are those of either read. Some headers have no comment."""
    rows = lambda k: [(f"{HEAD}{i}" if i % 8 == 7 else f"{HEAD}{i} {k}:{KINDS[i % 5][0] if k == 1 else 'N'}:{KINDS[i % 5][1] if k == 2 else '0'}:NN x", "AAAAC"[: 5 if k == 1 else 3], "IIIII"[: 5 if k == 1 else 3]) for i in range(n)]
    return [write_fastq(tmp_path / f"{k}.fastq.gz", rows(k)) for k in (1, 2)]


def flags_of(i):
    failed, control = KINDS[i % 5]
    return (False, False) if i % 8 == 7 else (failed == "Y", control != "0")


def test_the_source_drops_templates(spark, tmp_path):
    both = [[p] for p in files(tmp_path)]
    for without in ((), ("failed",), ("control",), ("failed", "control")):
        want = [i for i in range(40) if not (("failed" in without and flags_of(i)[0]) or ("control" in without and flags_of(i)[1]))]
        rows = fastq.read_templates(spark, both, 7, without).select("rec_idx", "head_0", "seq_1").collect()
        assert sorted(r["rec_idx"] for r in rows) == want  # numbers are those in the file
        assert all(r["head_0"].split()[0] == f"{HEAD}{r['rec_idx']}" for r in rows)


def test_dropped_templates_do_not_become_rows(tmp_path):
    both = [[p] for p in files(tmp_path)]
    options = {"groups": json.dumps(both), "records": "10", "index": json.dumps({p[0]: fastq.line_index(p[0], 100) for p in both})}
    reader = fastq.FastqReader({**options, "without": '["failed", "control"]'})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(not any(flags_of(i)) for i in range(40))
    with pytest.raises(ValueError, match="not: short"):
        fastq.FastqReader({**options, "without": '["short"]'})


def test_counts_of_dropped_reads_stay(spark, tmp_path):
    (tmp_path / "out").mkdir()
    fq = files(tmp_path)
    o = Options(fq, sheet(tmp_path / "s.csv", ["a,AAAA", "b,CCCC"]), [ReadStructure.parse("4B+T"), ReadStructure.parse("+T")], str(tmp_path / "out"), filter_control_reads=True, filter_failing_quality=True)
    counts = run(spark, o, records_per_task=9)
    stay = [i for i in range(40) if not any(flags_of(i))]
    assert counts["a_S1_L001_R1_001.fastq.gz"] == counts["a_S1_L001_R2_001.fastq.gz"] == len(stay)
    failing = sum(flags_of(i)[0] for i in range(40))
    control = sum(flags_of(i)[1] and not flags_of(i)[0] for i in range(40))
    assert tsv(tmp_path / "out/metrics.tsv") == [{"control_reads_omitted": str(control), "failing_reads_omitted": str(failing), "total_templates": str(len(stay))}]
    assert [h.split()[0] for h, _, _ in read_fastq(tmp_path / "out/a_S1_L001_R1_001.fastq.gz")] == [f"{HEAD}{i}" for i in stay]


def test_the_planner_reads_no_whole_files(spark, tmp_path):
    fq = files(tmp_path)
    spark.dataSource.register(fastq.FastqSource)
    with pytest.raises(Exception, match="No line index"):
        spark.read.format("fastq").options(groups=f'[["{fq[0]}"]]').load().count()
