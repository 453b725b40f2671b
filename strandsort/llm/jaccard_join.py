"""Near-duplicate join: Jaccard similarity of word shingles, by a MinHash LSH forest and exact verification.

Method. One pass over the texts gives each a digest of its words and a signature of ``trees * depth`` minima. Texts with
equal words form a class (a node); everything after works on one row per class. Each tree is a prefix trie of signature
parts: texts that share a prefix of length k meet in one of its nodes. What meets at a prefix also meets at each shorter
one, so that matching starts at the longest prefixes at which a pair right at the threshold is met with the target recall
or more. From there prefixes are shortened by one symbol at a time while the estimated recall of the pairs found
(Horvitz-Thompson over their similarities, each pair once, those a little below the threshold by their signatures too) is
below the target. Pairs whose estimated similarity is far below the threshold are dropped; the rest make clusters, and
within clusters every pair is compared by its exact shingle sets.

A group of any size is dealt out in blocks: each task compares two blocks and returns one row per text (sums of links
and the least text it is connected with), so that no pairs are written and no group meets in one task.

Edge cases: words are maximal runs of characters other than ASCII white space, lower-cased. A text of one to four words
has one shingle, all of its words. A null text or one without words has no links and is its own class. Repeated rows and
equal texts are copies: each counts as a link of the other. A null id stays null and its row is kept; a class whose ids
are all null has a null class id. Rows are keyed by the words' 64-bit digest, so that repeated ids do no harm; what stays
of a class is found by its id together with a 64-bit digest of its text. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.llm import words as W
from strandsort.llm.common import carry, cut, pick, put_back, table, text_key
from strandsort.llm.graph import components


@dataclass(frozen=True)
class Forest:
    shingle: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 6
    #: Of pairs at the threshold: 16 trees reach it at prefixes of four symbols (0.9998).
    target_recall: float = 0.9995
    #: Pairs with a similarity of their signatures below threshold - slack are no candidates (five standard deviations).
    slack: float = 0.2
    #: Texts in a block; a task holds two blocks of signatures, or of shingle sets of half as many texts.
    block: int = 512
    seed: int = 11
    #: Up to so many ids are broadcast (24 bytes each); more are joined by a shuffle.
    broadcast_rows: int = 500_000

    def meets(self, similarity: np.ndarray, k: int) -> np.ndarray:
        """Chance that two texts share a prefix of length k in one tree or more."""
        return 1 - (1 - similarity**k) ** self.trees

    @property
    def first_prefix(self) -> int:
        """The longest prefix at which pairs at the threshold reach the target recall; 1 if none does."""
        return max((k for k in range(1, self.depth + 1) if self.meets(self.threshold, k) >= self.target_recall), default=1)


SIGNED = "doc_id long, key long, node long, n long, sig binary"


def signatures(documents: DataFrame, forest: Forest) -> DataFrame:
    m = forest.trees * forest.depth
    rng = np.random.default_rng(forest.seed)
    times, plus = (rng.integers(0, 1 << 32, m, np.uint64).astype(np.uint32) for _ in range(2))
    times |= np.uint32(1)
    n = forest.shingle

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in W.pieces(batch.column("text")):
                h, _, _, first = W.words(texts)
                s, off = W.shingles(h, first, n)
                low, full = (s >> np.uint64(32)).astype(np.uint32), np.flatnonzero(np.diff(off))
                sig = np.zeros((len(texts), m), np.uint32)
                if len(full):
                    begin = off[:-1][full]
                    for k in range(m):
                        sig[full, k] = np.minimum.reduceat(low * times[k] + plus[k], begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        batch.column("key").slice(at, len(texts)),
                        pa.array(W.sequence_digest(h, first).view(np.int64)),
                        pa.array(np.diff(off), pa.int64()),
                        pa.array([r.tobytes() for r in sig], pa.binary()),
                    ],
                    names=["doc_id", "key", "node", "n", "sig"],
                )

    return documents.mapInArrow(signed, SIGNED)


def blocks(members: DataFrame, group: str, most: int) -> DataFrame:
    """Deal the members (group, node, size of the group) into pairs of blocks: own, lo, hi."""
    own = F.pmod(F.xxhash64("node", group), F.ceil(F.col("members") / most))
    dealt = members.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / most) - 1)))
    return dealt.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_other", "members")


def level(nodes: DataFrame, forest: Forest, k: int) -> DataFrame:
    """Edges (a, b) between texts that meet at prefix length k; rows with a null a sum up pairs found and expected."""
    keys = [F.xxhash64(F.lit(t), F.substring("sig", t * forest.depth * 4 + 1, k * 4)) for t in range(forest.trees)]
    met = nodes.select("node", F.explode(F.array(*keys)).alias("bucket"))
    full = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    dealt = blocks(met.join(full, "bucket"), "bucket", forest.block).join(nodes.select("node", "sig"), "node")
    m, floor, order = forest.trees * forest.depth, forest.threshold - forest.slack, ["bucket", "lo", "hi"]
    border = forest.threshold - (forest.threshold * (1 - forest.threshold) / m) ** 0.5  # one standard deviation lower

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in W.whole_groups(batches, order):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, m)
            node, own, lo, hi = (np.asarray(t.column(c)) for c in ("node", "own", "lo", "hi"))
            b = W.bounds(t, order)
            a_s, b_s, found, expected = [], [], 0.0, 0.0
            for x, y in zip(b[:-1], b[1:], strict=True):
                step = max(1, 60_000 // (y - x))
                for i in range(x, y - 1, step):
                    p, q = np.nonzero(np.arange(x, y)[None, :] > np.arange(i, min(i + step, y))[:, None])
                    p, q = p + i, q + x
                    if lo[x] != hi[x]:
                        p, q = p[w := own[p] != own[q]], q[w]
                    same = np.count_nonzero(sig[p] == sig[q], axis=1) / m
                    keep = same >= floor
                    p, q, same = p[keep], q[keep], same[keep]
                    a_s.append(p)
                    b_s.append(q)
                    near = same >= border
                    if near.any():  # a pair meets in one tree or more, and counts once over all of them
                        alike = (sig[p[near]] == sig[q[near]]).reshape(-1, forest.trees, forest.depth)[:, :, :k].all(axis=2)
                        once = 1 / np.maximum(1, alike.sum(axis=1))
                        found, expected = found + float(once.sum()), expected + float((once / forest.meets(same[near], k)).sum())
            p, q = np.concatenate(a_s or [np.zeros(0, int)]), np.concatenate(b_s or [np.zeros(0, int)])
            root = node[W.roots(len(node), p, q, node)]
            far = root != node
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*node[far].tolist(), None], pa.int64()),
                    pa.array([*root[far].tolist(), None], pa.int64()),
                    pa.array([0.0] * int(far.sum()) + [found], pa.float64()),
                    pa.array([0.0] * int(far.sum()) + [expected], pa.float64()),
                ],
                names=["a", "b", "found", "expected"],
            )

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(linked, "a long, b long, found double, expected double")


def clusters(nodes: DataFrame, forest: Forest) -> DataFrame:
    """(node, component) of candidates, shortening the prefixes until the target recall."""
    for k in range(forest.first_prefix, 0, -1):
        here = cut(level(nodes, forest, k))
        found, expected = here.agg(F.sum("found"), F.sum("expected")).first()
        if not found or found / expected >= forest.target_recall:
            break
    return components(here.filter("a IS NOT NULL").select("a", "b"), forest.broadcast_rows)


def held(groups: DataFrame, members: DataFrame, forest: Forest) -> DataFrame:
    """A table with a row for each group of members, which may be large: broadcast up to a bound, so that none meets in one task."""
    return F.broadcast(groups) if members.count() <= forest.broadcast_rows else groups


def verified(documents: DataFrame, nodes: DataFrame, near: DataFrame, forest: Forest) -> DataFrame:
    """(node, root, links): exact links to other classes, in rows of theirs, and the least node connected; a row per block pair."""
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    members = cut(near.join(held(sizes, near, forest), "component").join(nodes.select("node", "first_id", "rows"), "node"))
    ids = members.select("first_id").distinct()
    if ids.count() <= forest.broadcast_rows:
        ids = F.broadcast(ids)
    n = forest.shingle

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in W.pieces(batch.column("text")):
                h, _, _, first = W.words(texts)
                s, off = W.shingles(h, first, n)
                sets = [np.unique(s[a:b]).view(np.int64) for a, b in zip(off[:-1], off[1:], strict=True)]
                values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(W.sequence_digest(h, first).view(np.int64)), pa.ListArray.from_arrays(at, values)], names=["node", "set"])

    texts = documents.join(ids, documents.doc_id.eqNullSafe(F.col("first_id")), "left_semi").select("text")
    sets = texts.mapInArrow(shingled, "node long, set array<long>").filter("size(set) > 0")
    order = ["component", "lo", "hi"]
    dealt = blocks(members.drop("first_id"), "component", forest.block // 2).join(sets, "node")
    share = forest.threshold - 1e-9

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in W.whole_groups(batches, order):
            b = W.bounds(t, order)
            node, own, rows, lo, hi = (np.asarray(t.column(c)) for c in ("node", "own", "rows", "lo", "hi"))
            lists = t.column("set").combine_chunks()
            values, off = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for x, y in zip(b[:-1], b[1:], strict=True):
                at = x + np.sort(np.unique(node[x:y], return_index=True)[1])  # a class may come from several equal rows
                if len(at) < 2:
                    continue
                own_sets = [values[off[i] : off[i + 1]] for i in at]
                size = np.array([len(v) for v in own_sets], float)
                both = shared(own_sets)
                link = both >= share * (size[:, None] + size[None, :] - both)
                np.fill_diagonal(link, False)
                if lo[x] != hi[x]:
                    link &= own[at][:, None] != own[at][None, :]
                p, q = np.nonzero(link)
                out.append((node[at], node[at][W.roots(len(at), p, q, node[at])], link @ rows[at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in zip(*out, strict=True)], names=["node", "root", "links"])

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(compared, "node long, root long, links long")


def shared(sets: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Sizes of all pairs' intersections; values of one set only play no part."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], float)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number = np.cumsum(times > 1) - 1
    row, column = row[keep := times[column] > 1], number[column[keep]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, slab):
        a, z = np.searchsorted(column, [begin, begin + slab])
        x = np.zeros((len(sets), slab), np.float32)
        x[row[a:z], column[a:z] - begin] = 1
        both += x @ x.T
    return both.astype(float)


def classes(documents: DataFrame, id_col: str, text_col: str, forest: Forest) -> DataFrame:
    """near_duplicates() with each row's text_key() and its class as a component; the component is null for texts without words."""
    docs = pick(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", text_key("text"))
    signed = cut(signatures(docs, forest))
    nodes = cut(signed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.first("sig").alias("sig")))
    pairs = cut(verified(docs, nodes, clusters(nodes, forest), forest))
    joined = components(pairs.select(F.col("node").alias("a"), F.col("root").alias("b")), forest.broadcast_rows)
    links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    linked = joined.join(nodes.select("node", "first_id"), "node")
    heads = linked.groupBy("component").agg(F.min("first_id").alias("class_id"))
    linked = linked.join(held(heads, joined, forest), "component").select("node", "component", "class_id", F.lit(True).alias("is_linked"))
    known = nodes.drop("sig").join(links, "node", "left").join(linked, "node", "left")
    class_id = F.when(F.col("is_linked"), F.col("class_id")).otherwise(F.col("first_id"))
    known = cut(known.select("node", F.coalesce("component", "node").alias("component"), class_id.alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")))
    full, empty = signed.filter("n > 0").select("doc_id", "key", "node"), signed.filter("n = 0")
    alone = empty.select("doc_id", "key", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.join(known, "node").select("doc_id", "key", "component", "class_id", "n_links").union(alone)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, class_id (the least id it is connected with) and n_links (documents at the threshold or above)."""
    return classes(documents, id_col, text_col, forest).select("doc_id", "class_id", "n_links")


def keep_one(documents: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row of each class, one with the class id; every row without words stays, as it is its own class.

    Rows are told apart by id and text together, so that null and repeated ids are ids like any others.
    """
    found = classes(documents, "doc_id", "text", forest).filter("doc_id <=> class_id")
    times = found.filter("component IS NOT NULL").groupBy("component", "doc_id", "key").agg(F.count(F.lit(1)).alias("_times"))
    heads = times.groupBy("component", "doc_id").agg(F.min(F.struct("key", "_times")).alias("head")).select("doc_id", "head.key", "head._times")
    alone = found.filter("component IS NULL").select("doc_id", "key").distinct().withColumn("_times", F.lit(1).cast("long"))
    first = cut(heads.union(alone)).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    if first.count() <= forest.broadcast_rows:
        first = F.broadcast(first)
    rows = carry(documents, doc_id="doc_id", text="text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & text_key("text").eqNullSafe(F.col("_key"))
    kept = rows.join(first, same).select("_source", "_id", "_key", "_times")
    once, more = kept.filter("_times = 1"), kept.filter("_times > 1").dropDuplicates(["_id", "_key"])
    return once.union(more).select(*put_back(documents.columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, m.class_id, coalesce(k.c, 0) AS n_links
FROM documents d JOIN (SELECT a, min(b) AS class_id FROM r GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS c FROM l GROUP BY a) k ON k.a = d.doc_id
"""
