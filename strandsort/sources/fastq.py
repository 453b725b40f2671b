"""Block-gzip FASTQ files as a Spark data source, read by ranges of records.

``spark.read.format("fastq")`` with option ``groups``, a JSON list of lists of paths: the files of each FASTQ of a
template, in order. Planning needs the files' line counts: ``index`` counts them by a Spark job over ranges of bytes, each
of which begins at its first compressed block. Files are cut at record boundaries into ranges of about ``records``
records, and each task reads the same range of all groups, so that the reads of a template meet without a shuffle. Lines
become Arrow columns a few thousand records at a time. Files of unequal length are an error.

Option ``without`` (``failed``, ``control`` or both, a JSON list) drops templates, one of whose reads did not pass the
instrument's filter or is a control, before they become rows. It looks at whole headers only: one that lacks a part is
kept. It is an option and no pushed filter, as Spark 4.1 keeps what is pushed into a Python source with the loaded table,
where it then holds for every other plan that is made from the same DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandsort.sources import bgzf, files

#: (block start, lines before it) in ascending order; the last one is the file's end.
Marks = list[tuple[int, int]]


def count_range(path: str, start: int, end: int, every: int) -> tuple[Marks, int, bool | None]:
    """Marks of the blocks that begin in a range of bytes, its lines, and whether its last byte ends a line (null: it has none)."""
    marks, lines, last = [], 0, b""
    with files.reading(path) as f:
        first = bgzf.next_block(f, start, end)
        for at, _, data in bgzf.blocks(f, first, end) if first < end else ():
            if not marks or lines - marks[-1][1] >= every:
                marks.append((at, lines))
            lines += data.count(b"\n")
            last = data or last
    return marks, lines, last.endswith(b"\n") if last else None


def put_together(size: int, ranges: list[tuple[Marks, int, bool | None]]) -> Marks:
    """The marks of a file from those of its ranges."""
    out, before, closed = [], 0, True
    for marks, lines, ends in ranges:
        out += [(at, before + n) for at, n in marks]
        before, closed = before + lines, closed if ends is None else ends
    return [*(out or [(0, 0)]), (size, before + (not closed))]


def line_index(path: str, every: int) -> Marks:
    size = files.size(path)
    return put_together(size, [count_range(path, 0, size, every)])


def index(spark: SparkSession, paths: list[str], records: int, range_bytes: int = 64 << 20) -> dict[str, Marks]:
    """line_index of each file, counted by many tasks. The driver gets a few numbers for each range."""
    sizes = {p: files.size(p) for p in paths}
    ranges = [(p, at, min(at + range_bytes, n)) for p, n in sizes.items() for at in range(0, max(n, 1), range_bytes)]
    rows = spark.createDataFrame(ranges, "path string, start long, stop long").repartition(len(ranges))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [json.dumps(count_range(p, a, z, 4 * records)) for p, a, z in zip(*[b.column(c).to_pylist() for c in ("path", "start", "stop")], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("start"), pa.array(found, pa.string())], names=["path", "start", "found"])

    by: dict[str, list] = {p: [] for p in paths}
    for r in sorted(rows.mapInArrow(counted, "path string, start long, found string").collect(), key=lambda r: (r["path"], r["start"])):
        by[r["path"]].append(json.loads(r["found"]))
    return {p: put_together(sizes[p], [(list(map(tuple, m)), n, e) for m, n, e in found]) for p, found in by.items()}


def record_columns(data: bytes, path: str) -> list[pa.Array]:
    """head, seq and qual of records, from whole lines, four a record."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts - (raw[np.maximum(ends - 1, 0)] == 13)
    wrong = (raw[starts[0::4]] != ord("@")) | (raw[starts[2::4]] != ord("+")) | (sizes[1::4] != sizes[3::4])
    if wrong.any() or (raw > 127).any():
        at = 4 * int(np.flatnonzero(wrong)[0]) if wrong.any() else 0
        raise ValueError(f"Malformed FASTQ record in {path}: {data[starts[at] : ends[at + 3]]!r}")
    lines = pa.Array.from_buffers(pa.large_utf8(), len(ends), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    part = lambda k: pc.utf8_rtrim(lines.take(pa.array(np.arange(k, len(ends), 4))), characters="\r\n")
    return [x.cast(pa.string()) for x in (pc.utf8_slice_codeunits(part(0), 1), part(1), part(3))]


def records_of(path: str, marks: Marks, first: int, count: int, at_once: int = 4096) -> Iterator[list[pa.Array]]:
    """head, seq and qual of ``count`` records from number ``first`` on, ``at_once`` at a time."""
    at, before = max((m for m in marks[:-1] if m[1] <= 4 * first), default=marks[0])
    skip, held, lines, left = 4 * first - before, [], 0, count

    def taken(n: int) -> bytes:
        """The first n lines of what is held; the rest stays."""
        nonlocal held, lines
        data = b"".join(held)
        to = int(np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[n - 1]) + 1 if n else 0
        held, lines = [data[to:]], lines - n
        return data[:to]

    with files.reading(path) as f:
        for _, _, data in bgzf.blocks(f, at, marks[-1][0]):
            held.append(data)
            lines += data.count(b"\n")
            if skip:
                n = min(skip, lines)
                taken(n)
                skip -= n
            while not skip and left and lines >= 4 * min(at_once, left):
                n = min(at_once, left)
                yield record_columns(taken(4 * n), path)
                left -= n
            if not left:
                return
    if any(held) and not b"".join(held[-1:]).endswith(b"\n"):
        held.append(b"\n")
        lines += 1
    if lines < 4 * left:
        raise ValueError(f"Malformed FASTQ record in {path}: it is cut off")
    yield record_columns(taken(4 * left), path)


def first_record(path: str) -> tuple[str, str, str]:
    with files.reading(path) as f:
        bgzf.check(f.read(bgzf.HEADER), path)
    try:
        head, seq, qual = next(records_of(path, [(0, 0), (files.size(path), 4)], 0, 1))
    except ValueError as e:
        raise ValueError(f"FASTQ has no whole record: {path}") from e
    return head[0].as_py(), seq[0].as_py(), qual[0].as_py()


class Range(InputPartition):
    def __init__(self, file: int, first: int, count: int):
        self.file, self.first, self.count = file, first, count


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.groups: list[list[str]] = json.loads(options["groups"])
        self.records = int(options.get("records", 1_000_000))
        given = json.loads(options.get("index", "{}"))
        if lacking := sorted({p for g in self.groups for p in g} - set(given)):
            raise ValueError(f"No line index of {', '.join(lacking)}: read_templates() makes them by a job, the planner would read whole files")
        self.marks = {p: [tuple(m) for m in given[p]] for g in self.groups for p in g}
        self.without = json.loads(options.get("without", "[]"))
        if unknown := set(self.without) - {"failed", "control"}:
            raise ValueError(f"Templates can be left out that are failed or control, not: {', '.join(sorted(unknown))}")

    def partitions(self) -> list[Range]:
        out = []
        for i, together in enumerate(zip(*self.groups, strict=True)):
            lines = {self.marks[p][-1][1] for p in together}
            if len(lines) > 1 or next(iter(lines)) % 4:
                raise ValueError(f"FASTQs have different numbers of records or a record is cut off: {', '.join(together)}")
            total = lines.pop() // 4
            out += [Range(i, k, min(self.records, total - k)) for k in range(0, total, self.records)]
        return out or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        paths, at = [g[partition.file] for g in self.groups], partition.first
        names = ["file_idx", "rec_idx", *[f"{part}_{i}" for i in range(len(paths)) for part in ("head", "seq", "qual")]]
        for reads in zip(*[records_of(p, self.marks[p], partition.first, partition.count) for p in paths], strict=True):
            n = len(reads[0][0])
            numbers = [pa.array(np.full(n, partition.file, np.int32)), pa.array(np.arange(at, at + n))]
            columns, at = [*numbers, *[c for r in reads for c in r]], at + n
            batch = pa.RecordBatch.from_arrays(columns, names=names)
            if self.without:
                told = flags([r[0] for r in reads])
                batch = batch.filter(pc.invert(reduce(pc.or_, [told[x] for x in self.without])))
            yield batch


#: The begin of a header with all parts of its name and comment.
WHOLE = "^(?:[^ :]*:){6}[^ ]* [^ :]*:"


def flags(heads: list[pa.Array]) -> dict[str, pa.Array]:
    """failed and control of templates, from their reads' headers."""
    out = {}
    for head in heads:
        is_like = lambda end, head=head: pc.match_substring_regex(head, WHOLE + end)
        here = {"failed": is_like("Y:[^ :]*:"), "control": pc.and_not(is_like("[^ :]*:[^ :]*:"), is_like("[^ :]*:0:"))}
        out = {k: pc.or_(out[k], v) if out else v for k, v in here.items()}
    return out


class FastqSource(DataSource):
    """file_idx, rec_idx, then head_<i>, seq_<i>, qual_<i> for each group."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        n = len(json.loads(self.options["groups"]))
        return "file_idx int, rec_idx long, " + ", ".join(f"head_{i} string, seq_{i} string, qual_{i} string" for i in range(n))

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def indexes(spark: SparkSession, groups: list[list[str]], records: int = 1_000_000) -> dict[str, Marks]:
    return index(spark, sorted({p for g in groups for p in g}), records)


def read_templates(spark: SparkSession, groups: list[list[str]], records: int = 1_000_000, without: tuple[str, ...] = (), marks: dict[str, Marks] | None = None) -> DataFrame:
    """Templates of the groups' files, but for those ``without``; their line indexes are built by Spark where they are not given."""
    if len({len(g) for g in groups}) != 1:
        raise ValueError("All groups must have the same number of files")
    spark.dataSource.register(FastqSource)
    marks = indexes(spark, groups, records) if marks is None else marks
    return spark.read.format("fastq").options(groups=json.dumps(groups), records=records, index=json.dumps(marks), without=json.dumps(without)).load()
