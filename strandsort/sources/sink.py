"""Outputs: file names, block-gzip FASTQ files written by tasks and committed together, and small reports."""

from __future__ import annotations

import csv
import io
import itertools
import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from strandsort.read_structure import FILE_LETTER, ReadStructure, outputs
from strandsort.samples import Sample
from strandsort.sources import bgzf, files
from strandsort.sources.commit import Job


def output_name(sample: Sample, kind: str, number: int) -> str:
    name = f"{sample.sample_id}_S{sample.ordinal + 1}_L00{sample.lane or 1}_{FILE_LETTER[kind]}{number}_001.fastq.gz"
    return f"{sample.project}/{name}" if sample.project else name


def output_names(samples: list[Sample], structures: list[ReadStructure], kinds: list[str]) -> dict[tuple[int, int], str]:
    """File name, under the output folder, of each (sample, output)."""
    return {(s.ordinal, k): output_name(s, kind, n) for s in samples for k, (_, kind, n) in enumerate(outputs(structures, kinds))}


#: What records are dealt and sorted by; a fragment is what has one key.
ORDER = ("sample_ordinal", "output", "file_idx", "_part")
#: Where files can't be written at any place, as in object stores, larger ones stay in parts.
JOIN_BYTES = 256 << 20


@dataclass(frozen=True)
class Fragment:
    """A range of records of an output, as compressed blocks in a file of its own."""

    key: tuple[int, ...]
    path: str
    records: int
    size: int
    crc: int


@dataclass
class Written(WriterCommitMessage):
    fragments: list[Fragment]


class FragmentWriter(DataSourceArrowWriter):
    """Writes sorted rows (ORDER, record) as fragments. What counts is what the tasks report that Spark commits: a task that
    is lost or runs twice leaves files of its own attempt, which nobody names, and which go with the run's folder."""

    def __init__(self, stage: str):
        self.stage = stage

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = []
        for key, group in itertools.groupby(runs(iterator, ORDER), key=lambda run: run[0]):
            path, n, size, crc = f"{self.stage}/fragments/{uuid.uuid4().hex}", 0, 0, 0

            def data(group=group) -> Iterator[bytes]:
                nonlocal n
                for _, rows, whole in group:
                    n += rows
                    yield whole

            with files.writing(path) as out:
                for block in bgzf.compress(data()):
                    out.write(block)
                    size, crc = size + len(block), zlib.crc32(block, crc)
            done.append(Fragment(key, path, n, size, crc))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        found = [asdict(f) for m in messages if m is not None for f in m.fragments]
        files.write_whole(f"{self.stage}/fragments.json", json.dumps(found).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files.remove_folder(f"{self.stage}/fragments")


class FragmentSink(DataSource):
    """Option ``stage``: a run's folder."""

    @classmethod
    def name(cls) -> str:
        return "fastq_fragments"

    def writer(self, schema: StructType, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(self.options["stage"])


def dealt(records: DataFrame, rows_per_part: int) -> DataFrame:
    """Records as text, dealt by output and range, so that a sample with most of the reads is written by many tasks."""
    text = F.concat(F.lit("@"), "head", F.lit("\n"), "seq", F.lit("\n+\n"), "qual", F.lit("\n")).alias("record")
    parted = records.withColumn("_part", F.floor(F.col("rec_idx") / rows_per_part))
    return parted.repartition(*ORDER).sortWithinPartitions(*ORDER, "rec_idx").select(*ORDER, text)


def write_outputs(records: DataFrame, names: dict[tuple[int, int], str], folder: str, rows_per_part: int = 2_000_000, layout: str = "files") -> dict[str, int]:
    """stage_outputs() and publish: all outputs appear in the folder, or none."""
    with Job(folder) as job:
        counts, staged = stage_outputs(records, names, job, rows_per_part, layout)
        job.publish(staged)
    return counts


def stage_outputs(records: DataFrame, names: dict[tuple[int, int], str], job: Job, rows_per_part: int = 2_000_000, layout: str = "files") -> tuple[dict[str, int], list[str]]:
    """Write records (sample_ordinal, output, file_idx, rec_idx, head, seq, qual) for a job to publish: counts by name, and the files.

    Tasks write fragments of ``rows_per_part`` records at most, and the driver sees their names, sizes and counts only.
    ``files``: each output is one file. Block gzip can be concatenated, and the fragments' sizes give their places, so that
    each is copied to its place by a task of its own; where a store can't write at a place, outputs of up to JOIN_BYTES
    are copied by one task each, and larger ones stay in parts. ``parts``: the fragments are the output, as
    ``<name>.parts/00000.fastq.gz`` and on, in order, and ``<name>.parts/manifest.json`` lists them; nothing is written
    twice. Names without records get an empty file. The folder is one that all executors share.
    """
    if layout not in ("files", "parts"):
        raise ValueError(f"Unknown layout: {layout!r}")
    spark = records.sparkSession
    spark.dataSource.register(FragmentSink)
    files.make_folder(f"{job.stage}/fragments")
    dealt(records, rows_per_part).write.format("fastq_fragments").mode("append").option("stage", job.stage).save()
    with files.reading(f"{job.stage}/fragments.json") as f:
        found = [Fragment(**{**x, "key": tuple(x["key"])}) for x in json.loads(f.read())]
    by: dict[tuple[int, ...], list[Fragment]] = {key: [] for key in names}
    for x in sorted(found, key=lambda x: x.key):  # a row for each fragment
        by[x.key[:2]].append(x)
    anywhere = files.local_path(job.stage) is not None
    in_parts = {k for k, v in by.items() if v and (layout == "parts" or not (anywhere or sum(x.size for x in v) <= JOIN_BYTES))}
    staged = []
    for k in in_parts:
        staged += as_parts(by[k], names[k], job)
    whole = {names[k]: v for k, v in by.items() if k not in in_parts}
    put_together(spark, {job.path(name): v for name, v in whole.items()}, anywhere)
    return {name: sum(x.records for x in by[k]) for k, name in names.items()}, [*staged, *whole]


def as_parts(fragments: list[Fragment], name: str, job: Job) -> list[str]:
    """Give fragments their places as parts of an output, with a manifest; the names of all."""
    folder, listed = f"{name.removesuffix('.fastq.gz')}.parts", []
    for i, x in enumerate(fragments):
        listed.append({"path": f"{i:05d}.fastq.gz", "records": x.records, "bytes": x.size, "crc32": x.crc})
        files.move(x.path, job.path(f"{folder}/{i:05d}.fastq.gz"))
    files.write_whole(job.path(f"{folder}/manifest.json"), json.dumps({"records": sum(x.records for x in fragments), "parts": listed}).encode())
    return [*[f"{folder}/{x['path']}" for x in listed], f"{folder}/manifest.json"]


def runs(batches: Iterator[pa.RecordBatch], order: tuple[str, ...]) -> Iterator[tuple[tuple, int, bytes]]:
    """(key, rows, text) of each stretch of equal keys in sorted batches; its records lie side by side in Arrow's memory."""
    for b in batches:
        keys = np.stack([np.asarray(b.column(c), np.int64) for c in order], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        text = b.column("record").cast(pa.large_string())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset :]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield tuple(keys[x].tolist()), y - x, text.buffers()[2].slice(int(at[x]), int(at[y] - at[x])).to_pybytes()


def put_together(spark: SparkSession, targets: dict[str, list[Fragment]], anywhere: bool) -> None:
    """Write each target from its fragments and the end block. ``anywhere``: a task a fragment, each at its place; else a task a target."""
    rows = []
    for path, fragments in targets.items():
        at = 0
        for i, x in enumerate([*fragments, None]):  # the last one is the end block, which the last fragment's task writes
            last = i + 1 >= len(fragments)
            if x is None and fragments:
                break
            rows.append((path, at, [(x.path, x.size, x.crc)] if x else [], last))
            at += x.size if x else 0
    if not anywhere:
        rows = [(path, 0, [(x.path, x.size, x.crc) for x in fragments], True) for path, fragments in targets.items()]
    if not rows:
        return
    work = spark.createDataFrame(rows, "target string, at long, fragments array<struct<path:string,size:long,crc:long>>, last boolean")
    work = work.repartition(len(rows), "target", "at")

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data = itertools.chain(*[checked(x["path"], x["size"], x["crc"]) for x in r["fragments"]], [bgzf.EOF] if r["last"] else [])
                put_at(r["target"], r["at"], data) if anywhere else put(r["target"], data)
            yield b.select(["target"])

    work.mapInArrow(copied, "target string").count()
    for path, fragments in targets.items():
        want = sum(x.size for x in fragments) + len(bgzf.EOF)
        if files.size(path) != want:
            raise OSError(f"{path} has {files.size(path)} bytes, not {want}")


def checked(path: str, size: int, crc: int) -> Iterator[bytes]:
    """The bytes of a fragment; an error if they are not those that were written."""
    seen, n = 0, 0
    with files.reading(path) as f:
        while block := f.read(1 << 20):
            seen, n = zlib.crc32(block, seen), n + len(block)
            yield block
    if (n, seen) != (size, crc):
        raise OSError(f"Fragment {path} is damaged")


def put_at(path: str, at: int, data: Iterator[bytes]) -> None:
    """Write into a file on a mounted file system from a place on; a task that runs again writes the same bytes."""
    fd = os.open(files.local_path(path), os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        for block in data:
            view = memoryview(block)
            while view:
                n = os.pwrite(fd, view, at)
                view, at = view[n:], at + n
        os.fsync(fd)
    finally:
        os.close(fd)


def put(path: str, data: Iterator[bytes]) -> None:
    """Write under a name of this attempt, then rename, so that the path never holds half a file."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    with files.writing(attempt) as out:
        for block in data:
            out.write(block)
    files.move(attempt, path)


def text_of(value) -> str:
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else "inf" if math.isinf(value) else repr(value)
    return "" if value is None else str(value)


def write_tsv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A report as one file. Reports have a row for each sample, project or barcode that is asked for."""
    with files.writing(path) as out:
        for line in [columns, *([text_of(r[c]) for c in columns] for r in rows.toLocalIterator())]:
            text = io.StringIO(newline="")
            csv.writer(text, delimiter="\t", lineterminator="\n").writerow(line)
            out.write(text.getvalue().encode())
