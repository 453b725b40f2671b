"""Frequent values in bounded memory: a mergeable counter sketch with error bounds, and their exact counts by a second pass.

A sketch holds at most ``size`` values with counts. Where there are more, the count of rank size + 1 is taken from all, and
what is left with nothing goes; the sum of what was taken is the sketch's error. A value's true count lies between its
count here and that plus the error, and the error is at most N / (size + 1) for N rows, so that every value with more
rows than that is there. Sketches are merged by adding counts and errors and cutting down again, which keeps the bounds.

Each task makes one sketch of its rows, a batch at a time. They are merged ``FAN_IN`` at a time, in rounds, so that no
task sees more than FAN_IN * size rows, whatever the number of distinct values. The exact path groups by value instead,
and shuffles each distinct one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsort.operators.numbering import checkpointed

FAN_IN = 64
SKETCH = "sketch long, value string, count long, error long, rows long"


def cut_down(values: pa.Array, counts: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray, int]:
    """At most ``size`` values, with what is left of their counts, and how much was taken."""
    if len(counts) <= size:
        return values, counts, 0
    taken = int(np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1])
    left = counts - taken
    return values.filter(pa.array(left > 0)), left[left > 0], taken


def added(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Values of several sketches, each once, with the sums of their counts."""
    both = pa.table({"v": pa.chunked_array([v for v, _ in parts], pa.string()), "n": pa.array(np.concatenate([n for _, n in parts]).astype(np.int64))})
    summed = both.group_by("v").aggregate([("n", "sum")])
    return summed["v"].combine_chunks().cast(pa.string()), np.asarray(summed["n_sum"])


def rows_of(number: int, values: pa.Array, counts: np.ndarray, error: int, rows: int) -> pa.Table:
    """A sketch as rows; an empty one has a row without a value, which carries its error and rows."""
    n = max(len(values), 1)
    same = lambda x: pa.array(np.full(n, x, np.int64))
    if not len(values):
        values, counts = pa.array([None], pa.string()), np.zeros(1, np.int64)
    return pa.table({"sketch": same(number), "value": values, "count": pa.array(counts.astype(np.int64)), "error": same(error), "rows": same(rows)})


def sketched(values: DataFrame, size: int) -> DataFrame:
    """A sketch (SKETCH) of the first column, of strings, for each task. Nulls do not count."""
    name = values.columns[0]

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, error, rows = pa.array([], pa.string()), np.zeros(0, np.int64), 0, 0
        for batch in batches:
            column = batch.column(name).drop_null()
            rows += len(column)
            seen = pc.value_counts(column)
            fresh = (seen.field("values").cast(pa.string()), np.asarray(seen.field("counts")))
            held, counts, taken = cut_down(*added([(held, counts), fresh]), size)
            error += taken
        if rows:
            yield from rows_of(0, held, counts, error, rows).to_batches()

    one = values.select(F.col(name).cast("string").alias(name)).mapInArrow(of_task, SKETCH)
    return one.withColumn("sketch", F.spark_partition_id().cast("long"))


def merged(sketches: DataFrame, size: int) -> DataFrame:
    """One sketch from many: (value, count, error, rows)."""

    def of_group(group: pa.Table) -> pa.Table:
        sketch = np.asarray(group["sketch"])
        first = np.concatenate([[True], sketch[1:] != sketch[:-1]]) if len(sketch) else np.zeros(0, bool)
        error, rows = (int(np.asarray(group[c])[first].sum()) for c in ("error", "rows"))
        there = group.filter(pc.is_valid(group["value"]))
        values, counts, taken = cut_down(*added([(there["value"].combine_chunks().cast(pa.string()), np.asarray(there["count"]))]), size)
        return rows_of(int(sketch[0]) // FAN_IN, values, counts, error + taken, rows)

    now = checkpointed(sketches)
    while (now.agg(F.max("sketch")).first()[0] or 0) > 0:
        groups = now.withColumn("group", F.floor(F.col("sketch") / FAN_IN)).groupBy("group")
        now = checkpointed(groups.applyInArrow(lambda t: of_group(t.sort_by("sketch")), SKETCH))
    return now.select("value", "count", "error", "rows")


def frequent(values: DataFrame, size: int) -> DataFrame:
    """(value, at_least, at_most, rows): bounds of the counts of the values of the first column; all with more than rows / (size + 1) rows are among them."""
    found = merged(sketched(values, size), size).filter("value IS NOT NULL")
    return found.select("value", F.col("count").alias("at_least"), (F.col("count") + F.col("error")).alias("at_most"), "rows")


def frequent_exact(values: DataFrame, size: int) -> DataFrame:
    """frequent() with n, the exact count, of the values that have more than rows / (size + 1) rows: the sketch's values, at most
    ``size``, are counted in a second pass, and no other value is shuffled."""
    name = values.columns[0]
    bounds = checkpointed(frequent(values, size))
    held = values.select(F.col(name).cast("string").alias("value")).join(F.broadcast(bounds.select("value")), "value", "left_semi")
    counted = held.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(bounds), "value").filter(F.col("n") * (size + 1) > F.col("rows"))
