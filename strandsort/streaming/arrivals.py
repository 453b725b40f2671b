"""Runs whose files arrive one after another: a stream of complete sets of FASTQs, demultiplexed set by set.

The source watches a folder for files that are named like sequencer output. A set is the files of one prefix and lane, one
for each group that is asked for (``R1``, ``I1``, ...). It has arrived when all of them are there and end with block
gzip's end block, which a sequencer writes last. Arrived sets are numbered in a log, a file a number, made by a rename
that never replaces one: this is the order of the stream, and it is the same after a restart. Offsets are numbers.

``follow`` demultiplexes each batch of sets with the ordinary plan, whose reads are dealt over tasks by ranges. A batch has
a folder of its own, which is published as a whole and only once: a batch that Spark runs again after a failure, as its
checkpoint says, finds it and goes on. Its state for the metrics is kept under the batch's number, so that it counts once,
and the run's reports are made anew from all states.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from strandsort import run as R
from strandsort.operators import partial_metrics
from strandsort.options import Options
from strandsort.read_structure import KIND_OF_LETTER, KIND_ORDER, ReadStructure
from strandsort.sources import bgzf, commit, discovery, files

SCHEMA = "number long, prefix string, lane int, files array<string>"
GROUP = re.compile(r"([RIUS])(\d)")


def ends(path: str) -> bool:
    """Whether a file is whole: its last bytes are the end block."""
    size = files.size(path)
    if size < len(bgzf.EOF):
        return False
    with files.reading(path) as f:
        f.seek(size - len(bgzf.EOF))
        return f.read(len(bgzf.EOF)) == bgzf.EOF


def in_order(groups: list[str]) -> list[tuple[str, int]]:
    """Groups as (kind, number), in the order in which a run takes them."""
    found = []
    for g in groups:
        m = GROUP.fullmatch(g)
        if m is None:
            raise ValueError(f"Not a group of FASTQs, such as R1 or I2: {g!r}")
        found.append((KIND_OF_LETTER[m[1]], int(m[2])))
    return sorted(found, key=lambda g: (KIND_ORDER.index(g[0]), g[1]))


def arrived(folder: str, groups: list[tuple[str, int]], known: set[tuple[str, int]]) -> list[dict]:
    """The sets in a folder that are complete, but for those that are known, by name."""
    sets: dict[tuple[str, int], dict[tuple[str, int], str]] = {}
    for f in discovery.find(folder):
        if (f.prefix, f.lane) not in known:
            sets.setdefault((f.prefix, f.lane), {})[f.kind, f.number] = f.path
    whole = {k: [by[g] for g in groups] for k, by in sorted(sets.items()) if all(g in by for g in groups)}
    return [{"prefix": prefix, "lane": lane, "files": paths} for (prefix, lane), paths in whole.items() if all(map(ends, paths))]


class Log:
    """Numbered entries in a folder, each written once."""

    def __init__(self, folder: str):
        self.folder = folder
        files.make_folder(folder)
        self._read: list[dict] = []

    def entries(self) -> list[dict]:
        names = {n for n in files.names_in(self.folder) if n.isdigit()}
        while f"{len(self._read):09d}" in names:
            with files.reading(f"{self.folder}/{len(self._read):09d}") as f:
                self._read.append(json.loads(f.read()))
        return self._read

    def append(self, entry: dict) -> None:
        """By the one driver that a query has at a time."""
        files.write_whole(f"{self.folder}/{len(self.entries()):09d}", json.dumps(entry).encode())


class Sets(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.log = options["folder"], Log(options["log"])
        self.groups = in_order(json.loads(options["groups"]))
        self.most = int(options.get("maxsets", 64))

    def initialOffset(self) -> dict:
        return {"sets": 0}

    def latestOffset(self) -> dict:
        """Numbers ``maxSets`` new sets at most, so that a batch is bounded; the others come with the next one."""
        known = {(x["prefix"], x["lane"]) for x in self.log.entries()}
        for entry in arrived(self.folder, self.groups, known)[: self.most]:
            self.log.append(entry)
        return {"sets": len(self.log.entries())}

    def partitions(self, start: dict, end: dict) -> list[Sets]:
        entries = self.log.entries()[start["sets"] : end["sets"]]
        return [Sets([(start["sets"] + i, x["prefix"], x["lane"], x["files"]) for i, x in enumerate(entries)])]

    def read(self, partition: Sets) -> Iterator[tuple]:
        yield from partition.rows


class Arrivals(DataSource):
    """Options: folder, log (a folder of its own), groups (a JSON list), maxSets."""

    @classmethod
    def name(cls) -> str:
        return "fastq_arrivals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(self.options)


def arrivals(spark: SparkSession, folder: str, log: str, groups: list[str], max_sets: int = 64) -> DataFrame:
    """A stream of the sets that arrive in a folder."""
    in_order(groups)
    spark.dataSource.register(Arrivals)
    return spark.readStream.format("fastq_arrivals").options(folder=folder, log=log, groups=json.dumps(groups), maxSets=max_sets).load()


def demultiplex_batch(spark: SparkSession, options: Options, sets: list[dict], number: int, records_per_task: int = 1_000_000) -> None:
    """Outputs of a batch in ``batch-<number>`` of the output folder, its state, and the reports of all batches so far.

    Each step can be done again: outputs are published once, a state replaces the one of its name, reports are replaced.
    """
    out, name = options.output_dir, f"batch-{number:06d}"
    folder, done = f"{out}/{name}", f"{out}/{name}/_SUCCESS"
    files.make_folder(folder)
    commit.recover(folder)
    structures = options.read_structures or [ReadStructure.parse(f"+{kind}") for kind, _ in in_order(json.loads(sets[0]["groups"]))]
    groups = discovery.checked([discovery.Group([s["files"][i] for s in sets], x) for i, x in enumerate(structures)])
    p = R.prepare(replace(options, fastqs=[], output_dir=folder), groups)
    states = f"{out}/_states"
    if not files.is_file(done) or name not in partial_metrics.lanes(states):
        with commit.Job(folder) as job:
            counts, written, state = R.stage(spark, p, job, records_per_task, "files")
            partial_metrics.save(state, states, name)
            files.write_whole(job.path("_SUCCESS"), json.dumps(counts).encode())
            job.publish([*written, "_SUCCESS"])
    with commit.Job(out) as job:
        job.publish(R.write_reports(spark, p, job, partial_metrics.merged(spark, states)))


def follow(spark: SparkSession, options: Options, folder: str, groups: list[str], checkpoint: str, max_sets: int = 64, records_per_task: int = 1_000_000, **trigger) -> StreamingQuery:
    """Demultiplex what arrives in a folder, batch by batch; ``trigger`` as in DataStreamWriter.trigger(). A query that is
    started again with the same checkpoint goes on where it ended."""
    commit.recover(options.output_dir)
    stream = arrivals(spark, folder, f"{checkpoint}/arrivals", groups, max_sets)

    def each(batch: DataFrame, number: int) -> None:
        sets = [{**r.asDict(), "groups": json.dumps(groups)} for r in sorted(batch.collect(), key=lambda r: r["number"])]  # max_sets rows at most
        if sets:
            demultiplex_batch(batch.sparkSession, options, sets, number, records_per_task)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
