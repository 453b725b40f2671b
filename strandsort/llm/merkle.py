"""Merkle manifest of a table, with only every third level of its trees stored.

Rows are hashed to leaves and numbered in order within their tree (here a tree a language); eight consecutive nodes make
one node above, and the trees' roots are the leaves of a tree of their own. ``build`` stores level 0 and every
``STRIDE``-th level above. The levels between are regenerated when they are needed, for one aligned subtree at a time:
the 512 nodes or fewer of a stored level that lie below one node of the next stored level. So ``prove`` walks down from
the root: a stored node hands the siblings on its way to the root to its subtree, whose group regenerates what lies
between, adds the siblings of each of its own nodes, and forgets the rest.

Nothing but slim rows is shuffled: texts are hashed where they are read. A group has 512 rows at most, whatever share of
the table one tree has, and rows are numbered by ranges, in which equal rows are told apart by where they are read.

Edge cases: a null field is hashed as ``-``, which differs from an empty one (``0:``). A null tree is a tree of its own,
before all others. Null ids come first in their tree and are never tampered with; rows of equal ids are ordered by their
digests, so that equal rows are interchangeable and each has its own place and proof. Texts are hashed whole. An empty
table gives an empty result. Only the named columns are read, so that others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandsort.llm.common import pick, table, written_table

FAN = 8
#: Levels from one stored level to the next.
STRIDE = 3
BLOCK = FAN**STRIDE
#: A row id has its partition above these bits, and its place in the partition below.
PLACE_BITS = 33
#: Up to so many counts of (partition, tree) are broadcast, about 60 bytes each.
BROADCAST_COUNTS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Steps = list[dict]


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its number of bytes before it."""
    told = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.sha2(F.concat(*[told(c.cast("string")) for c in fields]), 256))


def tree_key(column: Column) -> Column:
    """A key that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))


def above(nodes: list[str]) -> list[str]:
    """The nodes of the next level; digests are hex text."""
    return [hashlib.sha256("".join(nodes[i : i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def regenerated(nodes: list[str], n: int, level: int) -> list[list[str]]:
    """An aligned subtree from its nodes of a stored level up to the node below which all of them lie."""
    out = [nodes]
    for _ in range(min(STRIDE, height(n) - level)):
        out.append(above(out[-1]))
    return out


def way_up(levels: list[list[str]], k: int) -> Steps:
    """For node k of the lowest level: its place among its run and the others of the run, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = k - k % FAN
        out.append({"pos": k - first, "others": "".join(nodes[first:k] + nodes[k + 1 : first + FAN])})
        k //= FAN
    return out


def fold(leaf: str, steps: Steps) -> str:
    """The root to which a leaf and its siblings lead."""
    for s in steps:
        at = 64 * s["pos"]
        leaf = hashlib.sha256((s["others"][:at] + leaf + s["others"][at:]).encode()).hexdigest()
    return leaf


def proof_digest(steps: Steps) -> str:
    return hashlib.sha256("".join(s["others"] for s in steps).encode()).hexdigest()


STEPS = "array<struct<pos:int,others:string>>"


@dataclass(frozen=True)
class Manifest:
    """``levels``: of each stored level (tree, idx, n, digest), n being the tree's leaves; level 0 also has the leaves' own
    columns. ``roots``: (tree, n, digest) of each tree."""

    levels: dict[int, DataFrame]
    roots: DataFrame

    def save(self, folder: str) -> None:
        for level, nodes in self.levels.items():
            nodes.write.parquet(f"{folder}/level={level}")
        self.roots.write.parquet(f"{folder}/roots")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Manifest:
        roots = spark.read.parquet(f"{folder}/roots")
        most = roots.agg(F.max("n")).first()[0] or 0
        return Manifest({k: spark.read.parquet(f"{folder}/level={k}") for k in stored_levels(most)}, roots)


def stored_levels(n: int) -> list[int]:
    return list(range(0, max(height(n), 1), STRIDE))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add idx, the place in the tree in the order of the columns, and n, the tree's leaves.

    Rows are dealt by ranges; of each range only its counts of the trees in it are looked at once more.
    """
    salted = leaves.withColumn("_salt", F.monotonically_increasing_id())  # tells rows apart that are equal in the order
    keys = ["tree", *order, "_salt"]
    spread = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_row", F.monotonically_increasing_id())
    place = F.col("_row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    held = written_table(spread.select("*", F.shiftright("_row", PLACE_BITS).alias("_part"), place.alias("_place")).drop("_row"))
    counts = held.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_place").alias("first"))
    by_tree = Window.partitionBy("tree")  # a row for each partition that has some of the tree
    before = F.sum("rows").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_before"), F.sum("rows").over(by_tree).alias("n"))
    counts = written_table(counts)
    if counts.count() <= BROADCAST_COUNTS:
        counts = F.broadcast(counts)
    return held.join(counts, ["tree", "_part"]).withColumn("idx", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("blk", F.floor(F.col("idx") / BLOCK).cast("long"))


def raising(level: int) -> Callable[[pa.Table], pa.Table]:
    """From a block of a stored level to the node above it."""

    def raised(group: pa.Table) -> pa.Table:
        by = sorted(zip(group["idx"].to_pylist(), group["digest"].to_pylist(), strict=True))
        top = regenerated([d.hex() for _, d in by], group["n"][0].as_py(), level)[-1][0]
        one = {name: group[name].slice(0, 1) for name in ("tree", "blk", "n")}
        return pa.table({"tree": one["tree"], "idx": one["blk"], "n": one["n"], "digest": pa.array([bytes.fromhex(top)], pa.binary())})

    return raised


def proving(level: int, make: Callable[[dict, Steps, dict], dict], arrow: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From a block of a stored level and what the node above it hands down to a row for each node that is asked for."""

    def proven(children: pa.Table, parent: pa.Table) -> pa.Table:
        if not children.num_rows or not parent.num_rows:
            return pa.Table.from_pylist([], arrow)
        rows, top = sorted(children.to_pylist(), key=lambda r: r["idx"]), parent.to_pylist()[0]
        subtree = regenerated([r["digest"].hex() for r in rows], rows[0]["n"], level)
        return pa.Table.from_pylist([make(r, way_up(subtree, k) + top["steps"], top) for k, r in enumerate(rows) if r["_asked"]], arrow)

    return proven


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest of leaves (tree, digest, ...) in the order of the columns."""
    nodes = written_table(numbered(leaves, order))
    levels, roots = {0: nodes}, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    for level in stored_levels(most):
        slim = in_blocks(nodes.select("tree", "idx", "n", "digest"))
        up = written_table(slim.groupBy("tree", "blk").applyInArrow(raising(level), "tree string, idx long, n long, digest binary"))
        reach = FAN ** (level + STRIDE)
        roots.append(up.filter(F.col("n") <= reach).select("tree", "n", "digest"))
        nodes = up.filter(F.col("n") > reach)
        if level + STRIDE in stored_levels(most):
            levels[level + STRIDE] = nodes
    found = roots[0] if roots else nodes.select("tree", "n", "digest")
    for r in roots[1:]:
        found = found.union(r)
    return Manifest(levels, found)


def prove(manifest: Manifest, tops: DataFrame, make: Callable[[dict, Steps, dict], dict], columns: list[str], schema: str, wanted: DataFrame | None = None) -> DataFrame:
    """What ``make`` makes of each leaf, the siblings on its way to the root, and its tree's row of ``tops``.

    ``tops`` has a row for each tree: tree, n, steps (from the tree's root on) and the binary ``columns``. ``wanted`` (tree, idx)
    names the leaves that are asked for; only their subtrees are regenerated. Without it all are.
    """
    levels = sorted(manifest.levels)
    asked = {}
    for level in levels if wanted is not None else ():
        below = wanted.select("tree", F.floor(F.col("idx") / FAN**level).cast("long").alias("idx")).distinct()
        asked[level] = in_blocks(below)
    handed = None
    for level in reversed(levels):
        nodes = in_blocks(manifest.levels[level].filter(F.col("n") > (FAN**level if level else 0)))
        here = (F.col("n") <= FAN ** (level + STRIDE)) & (F.col("n") > (FAN**level if level else 0))
        parents = tops.filter(here).select("tree", F.lit(0).cast("long").alias("blk"), "steps", *columns)
        if handed is not None:
            parents = parents.unionByName(handed)
        if level in asked:
            blocks = asked[level].select("tree", "blk").distinct()
            nodes = nodes.join(blocks, ["tree", "blk"], "left_semi").join(asked[level].select("tree", "idx", F.lit(True).alias("_asked")), ["tree", "idx"], "left")
        else:
            nodes = nodes.withColumn("_asked", F.lit(True))

        pairs = nodes.groupBy("tree", "blk").cogroup(parents.groupBy("tree", "blk"))
        if not level:
            return pairs.applyInArrow(proving(0, make, arrow_schema(schema)), schema)
        handing = lambda r, steps, top: {"tree": r["tree"], "blk": r["idx"], "steps": steps, **{c: top[c] for c in columns}}
        shape = f"tree string, blk long, steps {STEPS}" + "".join(f", {c} binary" for c in columns)
        handed = written_table(pairs.applyInArrow(proving(level, handing, arrow_schema(shape)), shape))
    raise ValueError("The manifest has no levels")


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def with_top(manifest: Manifest) -> DataFrame:
    """The roots of the trees with their ways to the one root above them: tree, n, steps, subroot, root."""
    trees = written_table(manifest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), "digest"))
    top = build(trees, ["name"])
    root = top.roots.select("tree", "n", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))
    made = lambda r, s, t: {"tree": r["name"], "n": r["leaves"], "steps": s, "subroot": r["digest"], "root": t["root"]}
    return prove(top, root, made, ["root"], f"tree string, n long, steps {STEPS}, subroot binary, root binary")


def documents_manifest(documents: DataFrame) -> Manifest:
    """Leaves of documents, a tree a language, by doc_id; changed is the leaf after tampering, where there is some."""
    docs = pick(documents, **{c: c for c in FIELDS})
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        tree_key(F.col("lang")).alias("tree"),
        "doc_id",
        digest_of([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(hit, digest_of([lowered if c == "text" else F.col(c) for c in FIELDS])).alias("changed"),
    )
    return build(written_table(leaves), ["doc_id", "digest"])


def verified_documents(documents: DataFrame) -> DataFrame:
    """Each document with its proof, and the root to which it leads after tampering: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    manifest = documents_manifest(documents)

    def row(leaf: dict, steps: Steps, top: dict) -> dict:
        root = top["root"].hex()
        folded = fold((leaf["changed"] or leaf["digest"]).hex(), steps)
        return {"doc_id": leaf["doc_id"], "leaf": leaf["digest"].hex(), "subroot": top["subroot"].hex(), "root": root, "proof_sha256": proof_digest(steps), "folded_root": folded, "verified": folded == root}

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return prove(manifest, with_top(manifest), row, ["subroot", "root"], schema)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_documents(table(spark, sf_dir, "documents"))


def _levels_sql(name: str, levels: int) -> str:
    """CTEs {name}1.. of the levels above {name}0 (t, i, d), and {name}s0.. of each node's siblings to the left and right."""
    out = []
    for k in range(levels + 1):
        src = f"(SELECT *, count(*) OVER (PARTITION BY t) AS c FROM {name}{k})"
        out.append(f"{name}c{k} AS (SELECT * FROM {src} q)")
        out.append(
            f"{name}s{k} AS (SELECT x.t, x.i, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r "
            f"FROM {name}c{k} x JOIN {name}c{k} y ON x.t = y.t AND x.i // {FAN} = y.i // {FAN} WHERE x.c > 1 GROUP BY x.t, x.i)"
        )
        if k < levels:
            out.append(f"{name}{k + 1} AS (SELECT t, i // {FAN} AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}c{k} WHERE c > 1 GROUP BY t, i // {FAN})")
    out.append(f"{name}roots AS (" + " UNION ALL ".join(f"SELECT t, d FROM {name}c{k} WHERE c = 1" for k in range(levels + 1)) + ")")
    return ",\n".join(out)


def _walk_sql(name: str, levels: int, tree: str, place: str, source: str, out: str) -> str:
    """CTEs that add siblings to ``sib`` and fold ``x`` level by level; the last one is named ``out``."""
    steps, before = [], source
    for k in range(levels + 1):
        now = out if k == levels else f"{out}{k}"
        steps.append(
            f"{now} AS (SELECT b.* EXCLUDE (sib, x), b.sib || coalesce(s.l || s.r, '') AS sib, CASE WHEN s.t IS NULL THEN b.x ELSE sha256(s.l || b.x || s.r) END AS x "
            f"FROM {before} b LEFT JOIN {name}s{k} s ON s.t = b.{tree} AND s.i = b.{place} // {FAN**k})"
        )
        before = now
    return ",\n".join(steps)


def _leaf_sql(text: str) -> str:
    told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', CAST({c} AS VARCHAR)) END"
    return "sha256(" + " || ".join(told(text if c == "text" else c) for c in FIELDS) + ")"


#: As many levels as tables of 8**8 documents a language and 8**4 languages have.
OP11_SQL = f"""
WITH crctab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) g(i))),
docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS t, {_leaf_sql("text")} AS leaf, {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                         lambda c, b: xor(c // 256, tab[1 + CAST(xor(c % 256, b) AS INT)])), 4294967295) AS crc
  FROM documents, crctab),
placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs),
a0 AS (SELECT t, i, leaf AS d FROM placed),
{_levels_sql("a", 8)},
b0 AS (SELECT 0 AS t, row_number() OVER (ORDER BY t) - 1 AS i, d FROM aroots),
{_levels_sql("b", 4)},
trees AS (SELECT t, d, row_number() OVER (ORDER BY t) - 1 AS top_i, 0 AS top_t FROM aroots),
start AS (SELECT p.doc_id, p.t, p.i, p.leaf, trees.d AS subroot, trees.top_i, trees.top_t, '' AS sib, CASE WHEN p.crc % 3 = 0 THEN p.other ELSE p.leaf END AS x FROM placed p JOIN trees USING (t)),
{_walk_sql("a", 8, "t", "i", "start", "low")},
{_walk_sql("b", 4, "top_t", "top_i", "low", "high")}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(sib) AS proof_sha256, x AS folded_root, x = r.d AS verified FROM high, broots r
"""
