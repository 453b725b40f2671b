"""Outputs are committed: whole after lost tasks, absent after failed runs, finished after a driver that ended early."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandsort.sources import bgzf, commit, files, sink

NAMES = {(0, 0): "p/a.fastq.gz", (1, 0): "b.fastq.gz", (2, 0): "none.fastq.gz"}

SCRIPT = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from strandsort.sources import sink
out, marks, times, how = sys.argv[1], sys.argv[2], int(sys.argv[3]), sys.argv[4]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
plain = sink.dealt

def dying(records, rows):
    df = plain(records, rows)
    def pass_on(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 40):
                part = batch.slice(k, 40)
                if k and 0 in part.column("sample_ordinal").to_pylist() and len(os.listdir(marks)) < times:
                    open(f"{marks}/{os.getpid()}-{len(os.listdir(marks))}", "w").close()
                    if how == "exit":
                        os._exit(1)
                    raise RuntimeError("lost")
                yield part
    return df.mapInArrow(pass_on, df.schema)

sink.dealt = dying
reads = spark.range(1000).select(F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("sample_ordinal"), F.lit(0).alias("output"), F.lit(0).alias("file_idx"),
    F.col("id").alias("rec_idx"), F.concat(F.lit("r"), "id").alias("head"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"))
print(sink.write_outputs(reads, {(0, 0): "p/a.fastq.gz", (1, 0): "b.fastq.gz", (2, 0): "none.fastq.gz"}, out, rows_per_part=300))
"""


def reads(spark, n=1000):
    """Nine in ten to one sample."""
    ids = spark.range(n).repartition(3)
    number = F.when(F.col("id") % 10 == 0, 1).otherwise(0)
    return ids.select(number.alias("sample_ordinal"), F.lit(0).alias("output"), F.lit(0).alias("file_idx"), F.col("id").alias("rec_idx"), F.concat(F.lit("r"), "id").alias("head"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"))


def heads(path) -> list[str]:
    with open(path, "rb") as f:
        data = b"".join(d for _, _, d in bgzf.blocks(f))
    return [line[1:] for line in data.decode().split("\n")[0::4] if line]


def everything(folder) -> list[str]:
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def expected(n=1000):
    return [f"r{i}" for i in range(n) if i % 10], [f"r{i}" for i in range(n) if i % 10 == 0]


def attempt(tmp_path, times, how):
    for d in ("out", "marks"):
        (tmp_path / d).mkdir()
    env = {**os.environ, "PYTHONPATH": f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"}
    return subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "out"), str(tmp_path / "marks"), str(times), how], capture_output=True, text=True, timeout=300, env=env)


@pytest.mark.parametrize("how", ["exit", "raise"])
def test_a_lost_task_leaves_no_trace(tmp_path, how):
    done = attempt(tmp_path, 2, how)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(os.listdir(tmp_path / "marks")) == 2  # tasks were lost in the middle of a fragment
    assert everything(tmp_path / "out") == sorted(NAMES.values())
    assert not [p for p in os.listdir(tmp_path / "out") if p.startswith(".")]
    assert (heads(tmp_path / "out/p/a.fastq.gz"), heads(tmp_path / "out/b.fastq.gz")) == expected()


def test_a_failed_run_publishes_nothing(tmp_path):
    done = attempt(tmp_path, 1000, "raise")
    assert done.returncode != 0
    assert os.listdir(tmp_path / "out") == []


def test_a_hot_sample_has_no_task_above_a_fragment(spark, tmp_path):
    with commit.Job(str(tmp_path)) as job:
        counts, staged = sink.stage_outputs(reads(spark), NAMES, job, rows_per_part=100)
        found = json.loads(Path(job.stage, "fragments.json").read_text())
        assert len(found) == 20 and max(x["records"] for x in found) == 90
        assert all(zlib.crc32(Path(x["path"]).read_bytes()) == x["crc"] and os.path.getsize(x["path"]) == x["size"] for x in found)
        assert everything(tmp_path / "p") == []  # nothing has its name before the run is committed
        job.publish(staged)
    assert counts == {"p/a.fastq.gz": 900, "b.fastq.gz": 100, "none.fastq.gz": 0}
    assert (heads(tmp_path / "p/a.fastq.gz"), heads(tmp_path / "b.fastq.gz")) == expected()
    assert (tmp_path / "none.fastq.gz").read_bytes() == bgzf.EOF and (tmp_path / "b.fastq.gz").read_bytes().endswith(bgzf.EOF)


def test_without_writes_at_a_place(spark, tmp_path, monkeypatch):
    """As in an object store: small outputs are joined by a task each, larger ones stay in parts."""
    monkeypatch.setattr(files, "local_path", lambda path: None)
    size = sum(1 for _ in expected()[0])
    monkeypatch.setattr(sink, "JOIN_BYTES", 2 * size)
    counts = sink.write_outputs(reads(spark), NAMES, f"file://{tmp_path}", rows_per_part=100)
    assert counts["p/a.fastq.gz"] == 900
    manifest = json.loads((tmp_path / "p/a.parts/manifest.json").read_text())
    assert manifest["records"] == 900 and len(manifest["parts"]) == 10
    assert [h for x in manifest["parts"] for h in heads(tmp_path / "p/a.parts" / x["path"])] == expected()[0]
    assert heads(tmp_path / "b.fastq.gz") == expected()[1]


def test_parts_as_output(spark, tmp_path):
    sink.write_outputs(reads(spark), NAMES, str(tmp_path), rows_per_part=400, layout="parts")
    assert everything(tmp_path) == sorted([f"p/a.parts/0000{i}.fastq.gz" for i in range(3)] + ["p/a.parts/manifest.json"] + [f"b.parts/0000{i}.fastq.gz" for i in range(3)] + ["b.parts/manifest.json", "none.fastq.gz"])
    listed = json.loads((tmp_path / "p/a.parts/manifest.json").read_text())["parts"]
    assert [h for x in listed for h in heads(tmp_path / "p/a.parts" / x["path"])] == expected()[0]
    assert all(zlib.crc32((tmp_path / "p/a.parts" / x["path"]).read_bytes()) == x["crc32"] for x in listed)
    with pytest.raises(ValueError, match="Unknown layout"):
        sink.write_outputs(reads(spark), NAMES, str(tmp_path), layout="heap")


def test_a_driver_that_ends_early_is_finished_by_the_next(tmp_path, monkeypatch):
    folder = str(tmp_path)
    (tmp_path / "a").write_text("old")
    ended = commit.Job(folder)
    for name in ("a", "x/b", "c"):
        Path(ended.path(name)).write_text(f"new {name}")
    with monkeypatch.context() as m:
        m.setattr(commit, "finish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            ended.publish(["a", "x/b", "c"])
    assert (tmp_path / "a").read_text() == "old"
    os.rename(f"{ended.stage}/final/c", tmp_path / "c")  # one move was done
    lost = commit.Job(folder)
    Path(lost.path("d")).write_text("never committed")
    assert commit.recover(folder) == [ended.stage]
    assert [(tmp_path / n).read_text() for n in ("a", "x/b", "c")] == ["new a", "new x/b", "new c"]
    assert commit.recover(folder) == [] and os.path.isdir(lost.stage)
    assert commit.recover(folder, sweep=True) == []
    assert everything(tmp_path) == ["a", "c", "x/b"] and not os.path.exists(lost.stage)


def test_what_is_not_written_is_not_published(tmp_path):
    with pytest.raises(FileNotFoundError, match="Not written: b"):
        with commit.Job(str(tmp_path)) as job:
            Path(job.path("a")).write_text("x")
            job.publish(["a", "b"])
    assert os.listdir(tmp_path) == []


def test_a_damaged_fragment_is_found(tmp_path):
    (tmp_path / "f").write_bytes(b"data")
    assert b"".join(sink.checked(str(tmp_path / "f"), 4, zlib.crc32(b"data"))) == b"data"
    with pytest.raises(OSError, match="damaged"):
        list(sink.checked(str(tmp_path / "f"), 4, zlib.crc32(b"dato")))
