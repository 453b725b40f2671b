"""Nearest-barcode matching.

A barcode is put as one-hot bits, four to a base, 15 bases to a long; N and other characters have none. The bases in
which it agrees with an expected barcode are the bits that both have, so that a distance is a few AND and bit counts on
literals, inside generated code. Up to ``INLINE`` samples, matching is a projection of the reads, with no join or
shuffle, whatever share of them one barcode has. With more samples, a sheet that is a table, or a matcher of the user's
own, each distinct barcode is matched once, by the index of ``pigeonhole``, and the matches are joined back: broadcast if
they are few, else by a shuffle that adaptive execution splits where a barcode is frequent. A stream has no distinct
barcodes to look up: there a row is compared with all samples of a large sheet, in batches.

Two rules decide, which differ near the thresholds: ``cached`` (best and runner-up by distance with free Ns) and
``precompute`` (all Ns are mismatches; a runner-up counts only within a horizon).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsort.functions.segments import n_calls
from strandsort.operators import pigeonhole
from strandsort.operators.barcodes import WORD, MatcherKind, choose, hot, one_hot  # noqa: F401
from strandsort.operators.numbering import checkpointed

#: Distance and sample in one number: the least is the nearest, of equal ones the first.
SHIFT = 1 << 20
#: Up to so many samples are compared with each row.
INLINE = 64
#: Up to so many distinct barcodes with a match are broadcast.
BROADCAST_BARCODES = 100_000

#: A matcher: from distinct barcodes (bc) and the expected ones to (bc, sample_ordinal, hamming_dist), rows that match only.
Matcher = Callable[[DataFrame, list[str]], DataFrame]


def distance(words: list[Column], compared: Column, expected: str) -> Column:
    """Mismatches, each N being one, over the bases that are compared."""
    same = [F.bit_count(w.bitwiseAND(F.lit(e))) for w, e in zip(words, hot(expected), strict=True)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return compared - total


def nearest(df: DataFrame, expected: list[str], free: Column, rival: Callable[[Column, Column], Column]) -> DataFrame:
    """Add _best, the nearest expected barcode as distance and number in one, and _near, how many are rivals of it, itself included."""
    c, hots = F.col, list(zip(*[hot(e) for e in expected], strict=True))
    first, *rest = [F.array(*[F.lit(h) for h in word]) for word in hots]

    def ranks(read: Column) -> Column:
        def rank(e: Column, i: Column) -> Column:
            same = F.bit_count(read["w0"].bitwiseAND(e))
            for k, word in enumerate(rest, 1):
                same = same + F.bit_count(read[f"w{k}"].bitwiseAND(F.get(word, i)))
            return (read["most"] - same).cast("long") * SHIFT + i

        return F.transform(first, rank)

    # arrays, as a column for each sample makes the code generated for a row too long to be compiled, and then it is
    # interpreted; an array of the read's one struct, as the optimiser would put the struct's making in place of each use
    read = F.struct(*[c(f"_w{k}").alias(f"w{k}") for k in range(len(hots))], (c("_len") - free).alias("most"))
    df = df.withColumn("_ranks", F.get(F.transform(F.array(read), ranks), F.lit(0)))
    df = df.withColumn("_best", F.array_min("_ranks"))
    return df.withColumn("_near", F.size(F.filter("_ranks", lambda r: rival(c("_best"), r)))).drop("_ranks")


def decided(reads: DataFrame, barcode: str, expected: list[str], kind: MatcherKind, max_mismatches: int, min_delta: int, free_ns: int) -> DataFrame:
    """Add sample_ordinal and hamming_dist by one of the two rules."""
    c, columns, length = F.col, reads.columns, len(expected[0])
    df = reads.withColumns(
        {f"_w{i}": w for i, w in enumerate(one_hot(c(barcode), length))} | {"_len": F.least(F.length(barcode), F.lit(length)), "_n": n_calls(F.substring(c(barcode), 1, length))}
    )
    dist = lambda r: F.shiftright(r, 20).cast("int")
    if kind is MatcherKind.CACHED:
        free = F.least(c("_n"), F.lit(free_ns))
        rival = lambda best, r: dist(r) - dist(best) <= min_delta
    else:
        free, has_n = F.lit(0), F.when(c("_n") > 0, 1).otherwise(0)
        in_reach = lambda r: (dist(r) <= max_mismatches) | ((dist(r) - has_n >= max_mismatches + 1) & (dist(r) <= max_mismatches + min_delta - 1))
        rival = lambda best, r: in_reach(r) & (dist(r) - dist(best) <= min_delta)
    # a filter on the match stops at a column that is not deterministic, and so does not compute the distances once more below; streams have no row id
    df = nearest(df, expected, free, rival).withColumn("_row", F.rand(0) if reads.isStreaming else F.monotonically_increasing_id())
    best = dist(c("_best"))
    found = (c("_row") >= 0) & (best <= max_mismatches) & (c("_near") == 1)
    if kind is MatcherKind.PRECOMPUTE:
        if max_mismatches == 0 and min_delta == 0:
            found = (c("_row") >= 0) & (best == 0)
        found = found & c(barcode).rlike(f"^[ACGTN]{{{length}}}$")
    hit = F.coalesce(found, F.lit(False))
    return df.select(*columns, F.when(hit, F.pmod(c("_best"), F.lit(SHIFT)).cast("int")).alias("sample_ordinal"), F.when(hit, best).alias("hamming_dist"))


def decided_in_batches(df: DataFrame, barcode: str, expected: list[str], kind: MatcherKind, max_mismatches: int, min_delta: int, free_ns: int) -> DataFrame:
    """As decided(), for so many samples that generated code would be too long: a matrix of distances for some barcodes at a time."""
    length, cached = len(expected[0]), kind is MatcherKind.CACHED
    want = np.frombuffer("".join(expected).encode(), np.uint8).reshape(-1, length)

    def of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each has a match, its number, its distance."""
        raw = b"".join((t or "")[:length].encode("ascii", "replace").ljust(length, b"\0") for t in texts)
        seen = np.frombuffer(raw, np.uint8).reshape(-1, length)
        sizes, base = np.array([len(t or "") for t in texts]), np.isin(seen, np.frombuffer(b"ACGT", np.uint8))
        n = (seen == ord("N")).sum(axis=1)
        dist = np.repeat(np.minimum(sizes, length).astype(np.int32)[:, None], len(want), axis=1)
        for j in range(length):
            dist -= (seen[:, j : j + 1] == want[None, :, j]) & base[:, j : j + 1]
        if cached:
            dist -= np.minimum(n, free_ns).astype(np.int32)[:, None]
        at = dist.argmin(axis=1)
        best = dist[np.arange(len(dist)), at]
        rival = dist - best[:, None] <= min_delta
        if not cached:
            rival &= (dist <= max_mismatches) | ((dist - (n > 0)[:, None] >= max_mismatches + 1) & (dist <= max_mismatches + min_delta - 1))
        found = (best <= max_mismatches) & (rival.sum(axis=1) == 1)
        if not cached:
            if max_mismatches == 0 and min_delta == 0:
                found = best == 0
            found &= (sizes == length) & (base.sum(axis=1) + n == length)
        return found & np.array([t is not None for t in texts], bool), at, best

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found, at, best = of(part.column(barcode).to_pylist())
                numbers = [pa.array(x.astype(np.int32), mask=~found) for x in (at, best)]
                yield pa.RecordBatch.from_arrays([*part.columns, *numbers], names=[*part.schema.names, "sample_ordinal", "hamming_dist"])

    number = [T.StructField(x, T.IntegerType()) for x in ("sample_ordinal", "hamming_dist")]
    return df.mapInArrow(matched, T.StructType([*df.schema.fields, *number]))


def by_distinct(reads: DataFrame, barcode: str, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Match each distinct barcode once, and join what matched. The barcodes and their matches are written between, so that
    the reads are read twice in all: for their barcodes, and to be joined."""
    seen = checkpointed(reads.select(F.col(barcode).alias("bc")).distinct())
    found = decide(seen).filter("sample_ordinal IS NOT NULL").select(F.col("bc").alias("_bc"), F.col("sample_ordinal").cast("int").alias("sample_ordinal"), F.col("hamming_dist").cast("int").alias("hamming_dist"))
    found = checkpointed(found)
    found = F.broadcast(found) if found.count() <= BROADCAST_BARCODES else found.hint("merge")  # the optimiser's estimate is that of the file they come from
    return reads.join(found, F.col(barcode) == F.col("_bc"), "left").drop("_bc")


def with_match(
    reads: DataFrame, barcode: str, expected: list[str] | DataFrame, kind: MatcherKind | Matcher, max_mismatches: int, min_delta: int, free_ns: int = 1, max_no_calls: int | None = None
) -> DataFrame:
    """Add sample_ordinal and hamming_dist, null for reads that match no expected barcode: a list, or a table (barcode, sample_ordinal)."""
    listed = isinstance(expected, list)
    if listed and not expected:
        return reads.withColumns({"sample_ordinal": F.lit(None).cast("int"), "hamming_dist": F.lit(None).cast("int")})
    rule = (kind, max_mismatches, min_delta, free_ns)
    if not isinstance(kind, MatcherKind):
        found = by_distinct(reads, barcode, lambda seen: kind(seen, expected))
    elif listed and len(expected) <= INLINE:
        found = decided(reads, barcode, expected, *rule)
    elif listed and reads.isStreaming:
        found = decided_in_batches(reads, barcode, expected, *rule)
    else:
        sheet = reads.sparkSession.createDataFrame([(e, i) for i, e in enumerate(expected)], "barcode string, sample_ordinal int") if listed else expected
        found = by_distinct(reads, barcode, lambda seen: pigeonhole.matches(seen, sheet, *rule))
    if max_no_calls is None:
        return found
    few = n_calls(F.col(barcode)) <= max_no_calls
    return found.withColumns({x: F.when(few, F.col(x)) for x in ("sample_ordinal", "hamming_dist")})
