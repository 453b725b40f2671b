"""Words that differ by one letter, found by probing edits against Bloom filters of the vocabulary.

The vocabulary is counted over all texts. For each length it has a blocked Bloom filter: a word sets ``BITS`` bits inside
one block of 512, so that a probe touches one cache line. The filters of all lengths are broadcast. Each word's
deletions and replacements, over the letters that occur in the vocabulary, are probed as whole arrays of numbers: an
edit's hash comes from the word's by a few additions and products. Only edits that the filter knows are spelled out and
shuffled, to an equi-join with the vocabulary, which removes false positives. A word and a longer one meet by the longer
one's deletion, so that insertions need no probes, and of two words of one length the one with the lesser letter probes.

The broadcast is bounded by ``filter_bytes``. A vocabulary too large for it is split by hash into parts, each with
filters of its own, and all edits are probed against one part after another: no edit is missed, and a larger vocabulary
costs more passes, not more memory.

A word's neighbours are at most its edits, whatever the corpus. Counts are combined before each shuffle.

Edge cases: a null text has no words; a null id counts as an empty one in the hash that picks the letters to delete.
Texts are read whole. Equal rows count as often as they stand. Words that tie as forms: the first in code-point order.
An empty table gives an empty result. Only id and text are read, so that other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.llm.common import cut, pick, table, written_table

# Fixed values of the task.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP_EVERY = 31
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10

BLOCK_WORDS = 8  # of 64 bits
BITS = 6
#: Bits of filter for a word: about one false positive in 1,500 probes.
BITS_PER_WORD = 16
FILTER_BYTES = 64 << 20
#: A row of the broadcast filters: a power of two of blocks, made by one task.
SEGMENT_BLOCKS = 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def slipped(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased letter runs of all texts, of which every 31st or so has lost a letter, with their counts.

    Runs shorter than a word can be are left out at once, as none gets longer.
    """
    docs = pick(documents, doc_id=id_col, text=text_col)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), 0)).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.select("run", F.crc32(told.cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % SLIP_EVERY == 0, shorter).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and each word's first place (n + 1)."""
    text = words.to_pylist()
    off = np.zeros(len(text) + 1, np.int64)
    np.cumsum([len(t) for t in text], out=off[1:])
    return np.frombuffer("".join(text).encode("utf-32-le"), np.uint32), off


def by_length(words: pa.Array, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words of one length, up to ``most`` letters in all or one word: their indexes and their letters as a matrix."""
    letters, off = codes(words)
    sizes = np.diff(off)
    for size in np.unique(sizes):
        index = np.flatnonzero(sizes == size)
        step = max(1, most // max(1, int(size)))
        for k in range(0, len(index), step):
            part = index[k : k + step]
            yield part, letters[off[part][:, None] + np.arange(size)].astype(np.uint64)


def weights(size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(matrix: np.ndarray) -> np.ndarray:
    """A number for each row of letters, which is the sum of a term for each letter and its place."""
    return ((matrix + np.uint64(1)) * weights(matrix.shape[1])[: matrix.shape[1]]).sum(axis=1, dtype=np.uint64)


def bits_of(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words inside a block, and the bits of each, that hashes stand for."""
    rest = mixed(h ^ np.uint64(0xD1342543DE82EF95))
    for k in range(BITS):
        bit = (rest >> np.uint64(9 * k)) & np.uint64(511)
        yield bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))


class Filters:
    """For each length its blocks as an array (blocks, 8); the number of blocks is a power of two."""

    def __init__(self, blocks: dict[int, np.ndarray]):
        self.blocks = blocks

    def knows(self, size: int, h: np.ndarray) -> np.ndarray:
        blocks = self.blocks.get(size)
        if blocks is None:
            return np.zeros(h.shape, bool)
        h = mixed(h)
        block = (h >> np.uint64(40)) & np.uint64(len(blocks) - 1)
        at, bit = next(bits_of(h))
        known = (blocks[block, at] & bit) != 0
        left = np.nonzero(known)  # most edits fail the first bit; the other bits are looked at for the rest only
        blocks, still = blocks[block[left]], np.ones(len(left[0]), bool)
        for at, bit in bits_of(h[left]):
            still &= (blocks[np.arange(len(blocks)), at] & bit) != 0
        known[left] = still
        return known


def block_counts(lengths: dict[int, int], filter_bytes: int) -> tuple[dict[int, int], int]:
    """Blocks for each length, and into how many parts the vocabulary is split so that a part's filters fit."""
    parts = 1
    while True:
        blocks = {size: 1 << max(0, (max(1, -(-n // parts)) * BITS_PER_WORD // 512).bit_length()) for size, n in lengths.items()}
        if 64 * sum(blocks.values()) <= filter_bytes or all(b == 1 for b in blocks.values()):
            return blocks, parts
        parts *= 2


def filters_of(words: DataFrame, blocks: dict[int, int]) -> Filters:
    """The filters of the words, built by many tasks, each a range of a filter's blocks; bounded by ``blocks``."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in by_length(batch.column("word"), 1 << 16):
                size, h = matrix.shape[1], mixed(sums(matrix))
                block = ((h >> np.uint64(40)) & np.uint64(blocks[size] - 1)).astype(np.int64)
                told = [pa.array(np.full(len(h), size, np.int32)), pa.array(block // SEGMENT_BLOCKS), pa.array(block % SEGMENT_BLOCKS), pa.array(h.view(np.int64))]
                yield pa.RecordBatch.from_arrays(told, names=["size", "segment", "block", "h"])

    def built(group: pa.Table) -> pa.Table:
        size, segment = group["size"][0].as_py(), group["segment"][0].as_py()
        out = np.zeros((min(SEGMENT_BLOCKS, blocks[size]), BLOCK_WORDS), np.uint64)
        block, h = np.asarray(group["block"]), np.asarray(group["h"]).view(np.uint64)
        for at, bit in bits_of(h):
            np.bitwise_or.at(out, (block, at.astype(np.int64)), bit)
        return pa.table({"size": pa.array([size], pa.int32()), "segment": pa.array([segment], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    keyed = words.select("word").mapInArrow(placed, "size int, segment long, block long, h long")
    rows = keyed.groupBy("size", "segment").applyInArrow(built, "size int, segment long, bits binary").collect()
    out = {size: np.zeros((n, BLOCK_WORDS), np.uint64) for size, n in blocks.items()}
    for r in rows:
        first = r["segment"] * SEGMENT_BLOCKS
        part = np.frombuffer(r["bits"], np.uint64).reshape(-1, BLOCK_WORDS)
        out[r["size"]][first : first + len(part)] = part
    return Filters(out)


def edits(matrix: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows of a matrix of words and edits of them that the filters know: deletions, then replacements by greater letters."""
    n, size = matrix.shape
    w, whole = weights(size), sums(matrix)
    terms = (matrix + np.uint64(1)) * w[:size]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    deleted = before[:, :-1] + (whole[:, None] - before[:, 1:]) * inverse
    fresh = np.ones((n, size), bool)
    fresh[:, 1:] = matrix[:, 1:] != matrix[:, :-1]  # of a run of one letter one deletion will do
    row, at = np.nonzero(fresh & filters.knows(size - 1, deleted)) if size - 1 in filters.blocks else (np.zeros(0, np.int64),) * 2
    yield row, spelled(matrix[row], at, None)
    if size in filters.blocks:
        for letter in alphabet:
            replaced = whole[:, None] + (letter - matrix) * w[:size]
            row, at = np.nonzero((matrix < letter) & filters.knows(size, replaced))
            yield row, spelled(matrix[row], at, letter)


def spelled(words: np.ndarray, at: np.ndarray, letter: np.uint64 | None) -> list[str]:
    """The words with their letter at a place replaced, or deleted."""
    if not len(words):
        return []
    words = words.astype(np.uint32)
    if letter is None:
        keep = np.arange(words.shape[1]) != at[:, None]
        words = words[keep].reshape(len(words), -1)
    else:
        words[np.arange(len(words)), at] = letter
    size = words.shape[1]
    text = np.ascontiguousarray(words).tobytes().decode("utf-32-le")
    return [text[k : k + size] for k in range(0, len(text), size)]


def near_pairs(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): each pair of words (word, n) that one insertion, deletion or replacement makes equal, once."""
    spark = vocabulary.sparkSession
    sizes = {r["size"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("size")).count().collect()}  # a row for each length
    alphabet = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # at most the letters of a run
    letters = np.array(sorted(ord(r["c"]) for r in alphabet if r["c"]), np.uint64)
    blocks, parts = block_counts(sizes, filter_bytes)
    found, tasks = None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in range(parts):
        own = vocabulary if parts == 1 else vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        known = spark.sparkContext.broadcast(filters_of(own, blocks).blocks)

        def probed(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            filters = Filters(known.value)
            for batch in batches:
                for index, matrix in by_length(batch.column("word")):
                    for row, made in edits(matrix, letters, filters):
                        if made:
                            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(index[row])).columns, pa.array(made, pa.string())], names=["word", "n", "near"])

        spread = vocabulary.select("word", "n").repartition(tasks, "word")  # a number of tasks, as the work is in the edits, not the bytes
        candidates = spread.mapInArrow(probed, "word string, n long, near string")
        pairs = candidates.join(own.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")
        found = pairs if found is None else found.union(pairs)
    return found


def variants(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES, ratio: int = FORM_RATIO) -> DataFrame:
    """word, n, n_near, form and form_n of each word of a vocabulary (word, n)."""
    pairs = near_pairs(vocabulary, filter_bytes)
    ends = F.array(*[F.struct(*[F.col(c).alias(x) for c, x in zip(cols, ("word", "near", "near_n"), strict=True)]) for cols in (("word", "near", "near_n"), ("near", "word", "n"))])
    both = pairs.select(F.explode(ends).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    groups = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocabulary.join(groups, "word", "left")
    good = -F.col("best.m") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """Add root: where the forms, each at least ten times as frequent as the one before, lead in the end.

    Each round joins the ways found so far with themselves, which doubles their length: a chain has at most as many
    links as the largest count has digits, so that four rounds or so end it.
    """
    ways = written_table(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return found.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(documents: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of all texts."""
    counted = slipped(documents).filter((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LENGTH))
    return with_roots(written_table(variants(written_table(counted), filter_bytes)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = r"""
WITH RECURSIVE crctab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) g(i))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) u WHERE length(run) >= 7),
told AS (SELECT run, count(*) AS times, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS x FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
                                     lambda c, b: xor(c // 256, tab[1 + CAST(xor(c % 256, b) AS INT)])), 4294967295) AS h
  FROM told, crctab),
slipped AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS z FROM (SELECT *, unnest(range(length(word))) AS i FROM v) q),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT c.word, v.word, v.n FROM cuts c JOIN v ON v.word = c.a || c.z
  UNION SELECT v.word, c.word, c.n FROM cuts c JOIN v ON v.word = c.a || c.z),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM pairs GROUP BY word),
named AS (SELECT b.word, b.n_near, b.m, min(p.near) AS w FROM best b JOIN pairs p ON p.word = b.word AND p.near_n = b.m GROUP BY b.word, b.n_near, b.m),
forms AS (
  SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 10 * v.n THEN w END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n
  FROM v LEFT JOIN named USING (word)),
walk AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
