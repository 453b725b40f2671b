"""Nearest-barcode matching against a sheet of any size, and the check of such a sheet, by equi-joins on blocks.

Two barcodes with at most r mismatches, cut into r + k blocks, agree in at least k of them. So the sheet is put in an index
with a row for each choice of k blocks of each barcode, and an observed barcode looks its own choices up there; what it
meets is verified by bit counts on one-hot words. Nothing is compared with all samples: k grows with the sheet, so that a
key is met by few samples by chance.

The search takes two steps. The first finds the nearest sample within the mismatches that are allowed: at most those and
the barcode's free Ns. The second looks for rivals of those barcodes only that have a nearest sample, up to its distance
and the delta. Whether the nearest is the only one follows from the least and the greatest sample found, so that a pair
that meets in several blocks does no harm. By the cached rule a sample with another one within the delta is never matched:
a read is at most so much farther from that one. Such samples are found once, from the sheet alone, and only the others
are looked for, so that a crowded sheet costs no more than a sparse one; as rivals all samples count.

A side is broadcast up to ``BROADCAST_ROWS`` rows, a size that is counted, and else both are joined by a shuffle: the
optimiser's estimate of an index is that of the file it is made of, many times too small, so that it is not asked. With
an index that is broadcast, all that follows is keyed by barcode, as the distinct barcodes are dealt already.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandsort.functions.segments import n_calls
from strandsort.operators.barcodes import WORD, MatcherKind, one_hot
from strandsort.operators.numbering import checkpointed

#: Rows of an index or of what is looked up in it, about 150 bytes each with their place in a hash table.
BROADCAST_ROWS = 100_000
#: Keys of a barcode for one radius.
MOST_KEYS = 256
#: What a key costs, by the pairs that could be verified meanwhile.
KEY_COST = 8
#: Samples, in their order, among which the first pair is looked for first.
FIRST_SAMPLES = 1000


def blocks(length: int, radius: int, rows: float = 0) -> list[list[tuple[int, int]]]:
    """Keys of a barcode, each some blocks (start from 1, size): any two barcodes within the radius agree in one of them.

    The number of blocks in a key is the cheapest for so many rows, as told by both(). A single empty key, in which all
    agree, if there are fewer bases than blocks.
    """
    ways = [k for k in range(1, length - radius + 1) if k == 1 or comb(radius + k, k) <= MOST_KEYS]
    if not ways:
        return [[(1, 0)]]
    k = min(ways, key=lambda k: comb(radius + k, k) * (KEY_COST + rows / 4.0 ** (length * k // (radius + k))))
    n = radius + k
    cuts = [length * i // n for i in range(n + 1)]
    return [list(some) for some in combinations([(a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], k)]


def both(looked: int, index: int) -> float:
    """Pairs by chance for each row that gets keys, whichever side it is of, times the number of keys' values."""
    return looked * index / max(1, looked + index)


def n_keys(length: int, radii: Iterable[int], rows: float) -> int:
    return sum(len(blocks(length, r, rows)) for r in radii)


def parts(barcode: Column, length: int, radii: Iterable[int], rows: float) -> Column:
    """An array of (radius, slot, part): the keys of a barcode for each radius."""
    return F.array(
        *[
            F.struct(F.lit(r).alias("radius"), F.lit(1000 * r + i).alias("slot"), F.concat(*[F.substring(barcode, at, size) for at, size in key]).alias("part"))
            for r in sorted(radii)
            for i, key in enumerate(blocks(length, r, rows))
        ]
    )


def words(length: int) -> int:
    return -(-length // WORD) if length else 0


def agreeing(length: int, a: str, b: str) -> Column:
    """Bases in which two barcodes with one-hot words agree."""
    same = [F.bit_count(F.col(f"{a}{i}").bitwiseAND(F.col(f"{b}{i}"))) for i in range(words(length))]
    total = F.lit(0)
    for s in same:
        total = total + s
    return total


def with_words(df: DataFrame, barcode: str, length: int, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{i}": w for i, w in enumerate(one_hot(F.col(barcode), length))}) if length else df


def distinct_of(sheet: DataFrame, length: int) -> DataFrame:
    """(_e, _ordinal, _many, _s0..) of the sheet's barcodes (barcode, sample_ordinal), cut to a length. Equal ones are one, with how many there are."""
    cut = sheet.groupBy(F.substring("barcode", 1, length).alias("_e")).agg(F.min("sample_ordinal").alias("_ordinal"), F.count(F.lit(1)).alias("_many"))
    return checkpointed(with_words(cut, "_e", length, "_s"))


def index_of(cut: DataFrame, length: int, radii: set[int], rows: float) -> DataFrame:
    """(slot, part, _ordinal, _many, _s0..) of distinct_of() or some of it, by keys for so many rows."""
    held = cut.withColumn("_p", F.explode(parts(F.col("_e"), length, radii, rows)))
    return held.select("_p.slot", "_p.part", "_ordinal", "_many", *[f"_s{i}" for i in range(words(length))])


def joined(looked: DataFrame, index: DataFrame, looked_rows: int | None, index_rows: int) -> DataFrame:
    """On their keys; one side is broadcast if it is known to be small."""
    if index_rows <= BROADCAST_ROWS:
        return looked.join(F.broadcast(index), ["slot", "part"])
    if looked_rows is not None and looked_rows <= BROADCAST_ROWS:
        return F.broadcast(looked).join(index, ["slot", "part"])
    return looked.join(index.hint("merge"), ["slot", "part"])


def met(seen: DataFrame, n_seen: int | None, cut: DataFrame, n_cut: int, length: int, radii: set[int], rows: float) -> DataFrame:
    """Each barcode (bc, _radius, ...) with the samples of the cut that it meets in a key, and their raw distance."""
    looked = with_words(seen, "bc", length, "_w").withColumn("_p", F.explode(F.filter(parts(F.col("bc"), length, radii, rows), lambda x: x["radius"] == F.col("_radius"))))
    looked = looked.select("*", "_p.slot", "_p.part").drop("_p")
    keys = n_keys(length, radii, rows)
    pairs = joined(looked, index_of(cut, length, radii, rows), None if n_seen is None else n_seen * keys, n_cut * keys)
    return pairs.withColumn("_raw", F.lit(length) - agreeing(length, "_w", "_s"))


def apart(cut: DataFrame, length: int, min_delta: int, rows: int) -> tuple[DataFrame, int]:
    """Those of distinct_of() that are one sample's only and have no other one within the delta, and how many they are.

    By growing distance, so that the farther ones are looked for only of barcodes that have none nearer.
    """
    c = F.col
    left = cut.filter("_many = 1")
    n_left = left.count()
    for r in range(1, min(min_delta, length) + 1):
        if not n_left:
            break
        own = left.select(c("_e").alias("bc"), c("_ordinal").alias("_own"), F.lit(r).alias("_radius"))
        near = met(own, n_left, cut, rows, length, {r}, both(n_left, rows)).filter((c("_raw") <= r) & (c("_ordinal") != c("_own")))
        left = checkpointed(left.join(near.select(c("bc").alias("_e")).distinct().hint("merge"), "_e", "left_anti"))
        n_left = left.count()
    return left, n_left


def of_length(seen: DataFrame, sheet: DataFrame, whole: int, length: int, kind: MatcherKind, max_mismatches: int, min_delta: int, free_ns: int) -> DataFrame:
    """(bc, sample_ordinal, hamming_dist) of the barcodes that match, all of whose compared parts have one length."""
    c, m = F.col, max_mismatches
    cached = kind is MatcherKind.CACHED
    free_most = free_ns if cached else 0
    seen = seen.select("bc", n_calls(F.substring(c("bc"), 1, whole)).alias("_n"))
    if not cached:
        seen = seen.filter(c("bc").rlike(f"^[ACGTN]{{{whole}}}$"))
    free = F.least(c("_n"), F.lit(free_most)) if free_most else F.lit(0)
    reach = m + min_delta + free_most if cached else max(m, m + min_delta - 1)
    first, second = set(range(m, m + free_most + 1)), set(range(min(min_delta, reach), reach + 1))
    cut = distinct_of(sheet, length)
    rows = cut.count()
    able, n_able = apart(cut, length, min_delta, rows) if cached else (cut, rows)
    near = met(seen.withColumn("_free", free).withColumn("_radius", F.lit(m) + c("_free")), None, able, n_able, length, first, n_able)
    best = near.filter(c("_raw") - c("_free") <= m).groupBy("bc", "_n", "_free").agg(F.min(F.struct((c("_raw") - c("_free")).cast("int").alias("d"), c("_ordinal").alias("s"))).alias("_best"))
    best = best.select("bc", "_n", "_free", c("_best.d").alias("_d"), c("_best.s").alias("_of"))
    if not cached and m == min_delta == 0:
        return best.select("bc", c("_of").alias("sample_ordinal"), c("_d").alias("hamming_dist"))
    best, n_best = best.withColumn("_radius", F.least(c("_d") + min_delta + c("_free"), F.lit(reach))), None
    dealt = rows
    if rows * n_keys(length, second, rows) > BROADCAST_ROWS:
        best = checkpointed(best)
        have = {r["_radius"]: r["count"] for r in best.groupBy("_radius").count().collect()}  # as many as the reach
        second, n_best = set(have) or {reach}, sum(have.values())
        dealt = both(n_best, rows)
    rivals = met(best, n_best, cut, rows, length, second, dealt).withColumn("_rival", c("_raw") - c("_free"))
    is_near = c("_rival") - c("_d") <= min_delta
    if not cached:
        has_n = F.when(c("_n") > 0, 1).otherwise(0)
        is_near = is_near & ((c("_rival") <= m) | ((c("_rival") - has_n >= m + 1) & (c("_rival") <= m + min_delta - 1)))
    ends = rivals.filter(is_near).groupBy("bc", "_n", "_free", "_d", "_of").agg(F.min("_ordinal").alias("_lo"), F.max("_ordinal").alias("_hi"), F.max("_many").alias("_k"))
    return ends.filter((c("_lo") == c("_hi")) & (c("_k") == 1)).select("bc", c("_of").alias("sample_ordinal"), c("_d").alias("hamming_dist"))


def matches(seen: DataFrame, sheet: DataFrame, kind: MatcherKind, max_mismatches: int, min_delta: int, free_ns: int) -> DataFrame:
    """(bc, sample_ordinal, hamming_dist) of the distinct barcodes (bc) that match a sample of the sheet (barcode, sample_ordinal).

    By the rules of ``matching.decided``. Barcodes shorter than the samples' are compared as far as they go, a plan for
    each length there is; none has more bases than a sample.
    """
    low, high = sheet.agg(F.min(F.length("barcode")), F.max(F.length("barcode"))).first()
    if low != high:
        raise ValueError(f"Sample barcodes must have the same length, not {low} to {high}")
    empty = seen.select("bc", F.lit(None).cast("int").alias("sample_ordinal"), F.lit(None).cast("int").alias("hamming_dist")).limit(0)
    if low is None:
        return empty
    lengths = seen.filter("bc IS NOT NULL").select(F.least(F.length("bc"), F.lit(high)).alias("n")).distinct().collect()  # as many as a barcode has bases
    found = None
    for n in sorted(r["n"] for r in lengths):
        if n < high and kind is not MatcherKind.CACHED:
            continue
        own = seen.filter(F.least(F.length("bc"), F.lit(high)) == n) if len(lengths) > 1 else seen
        part = of_length(own, sheet, high, n, kind, max_mismatches, min_delta, free_ns)
        found = part if found is None else found.union(part)
    return empty if found is None else found


def first_violation(sheet: DataFrame, max_mismatches: int, min_delta: int) -> DataFrame:
    """The first pair of samples, in their order, that reads could confuse: first, second, distance, fault. No row if there is none.

    sheet: sample_ordinal, barcode. Faults: ``length`` (unequal lengths), ``collision`` (fewer mismatches than are allowed)
    and ``delta`` (no more than the delta). Barcodes of unequal lengths first differ from the first sample's.

    Equal barcodes are one, with their first sample: a pair with a later one comes behind the pair of the two. The pair's
    first sample is looked for among the first ones of the sheet, then, as long as there is none, among 16 times as many.
    """
    c = F.col
    rows = sheet.select(c("sample_ordinal").cast("long").alias("i"), "barcode")
    schema = "first long, second long, distance int, fault string"
    head = rows.agg(F.min(F.struct("i", "barcode")).alias("h")).first()["h"]
    if head is None:
        return sheet.sparkSession.createDataFrame([], schema)
    size, radius = len(head["barcode"]), max(max_mismatches - 1, min_delta)
    odd = rows.filter(F.length("barcode") != size).agg(F.min("i")).first()[0]
    found = [] if odd is None else [(head["i"], odd, None, "length")]
    if radius >= 0:
        pair = first_near(rows.filter(F.length("barcode") == size), size, max_mismatches, min_delta, radius)
        found += [] if pair is None else [(*pair, "collision" if pair[2] < max_mismatches else "delta")]
    return sheet.sparkSession.createDataFrame(sorted(found, key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))[:1], schema)


def first_near(rows: DataFrame, size: int, max_mismatches: int, min_delta: int, radius: int) -> tuple[int, int, int] | None:
    """The first pair (i of both, distance) of rows (i, barcode) of one length with too small a distance."""
    c = F.col
    held = checkpointed(with_words(rows.groupBy("barcode").agg(F.min("i").alias("i"), F.max("i").alias("last")), "barcode", size, "_w"))
    n, copied, best = held.count(), held.filter("i < last"), None
    first = copied.agg(F.min("i")).first()[0]
    if first is not None:
        twins = copied.filter(c("i") == first).select("barcode")
        best = (first, rows.filter(c("i") > first).join(twins, "barcode", "left_semi").agg(F.min("i")).first()[0], 0)
    ends = [held.orderBy("i").limit(FIRST_SAMPLES).agg(F.max("i")).first()[0]]
    shares = [FIRST_SAMPLES * 16**k / n for k in range(1, 16) if FIRST_SAMPLES * 16**k < n]
    low, begun = None, 0
    while begun <= len(shares) + 1:
        if begun == 1 and shares:
            ends += held.agg(F.percentile_approx("i", shares, 10_000)).first()[0]
        end = ends[begun] if begun < len(ends) else None
        rest = held if low is None else held.filter(c("i") > low)
        some = rest if end is None else rest.filter(c("i") <= end)
        if best is not None:
            some = some.filter(c("i") <= best[0])
        n_some = some.count()
        if n_some:
            keyed = lambda df, p: df.withColumn("_p", F.explode(parts(c("barcode"), size, [radius], both(n_some, n)))).select("_p.slot", "_p.part", c("i").alias(f"{p}i"), *[c(f"_w{k}").alias(f"{p}{k}") for k in range(words(size))])
            keys = n_keys(size, [radius], both(n_some, n))
            pairs = joined(keyed(some, "a"), keyed(rest, "b"), n_some * keys, n * keys).filter("ai < bi")
            pairs = pairs.withColumn("distance", (F.lit(size) - agreeing(size, "a", "b")).cast("int"))
            wrong = pairs.filter((c("distance") < max_mismatches) | (c("distance") <= min_delta))
            least = wrong.agg(F.min(F.struct("ai", "bi", "distance")).alias("w")).first()["w"]
            if least is not None:
                return min(tuple(least), best or tuple(least))
        if end is None or (best is not None and end >= best[0]):
            break
        low, begun = end, begun + 1
    return best
