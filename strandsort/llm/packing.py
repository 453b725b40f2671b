"""Sum-of-squares packing of tokenised documents into windows of a fixed number of tokens.

A document's ids (by the tokenizer, then an end id) are cut at multiples of the window; full windows are sequences of
their own. The remainder goes, as it comes, to the open window whose fill level makes the sum of squared counts of
windows per level least (a new window counts as level 0): N[h] is the number of open windows that are filled up to h.
The state is that array of levels, whatever the number of documents.

Documents are tokenised where they are read. Only (id, place, length, checksum) of the pieces are shuffled, dealt evenly
into groups of about ``group_pieces`` pieces by their place in the written table, so that no key can make a group large;
each group packs on its own, and its open windows are all the padding.

Edge cases: a null text is empty, its document is the end id alone. Repeated rows are packed as often as they occur. A
null id stays null. An empty table gives an empty result. Texts are tokenised whole. Only ids and texts are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.llm import words as W
from strandsort.llm.common import cut, pick, table
from strandsort.llm.token_ids import token_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class Plan:
    tokenizer: str
    window: int = 2048
    end_id: int = 1
    group_pieces: int = 65_536


def tokenised(documents: DataFrame, plan: Plan) -> DataFrame:
    """The pieces of all documents: full windows, then what is left."""
    end, size = np.array([plan.end_id], "<u4").tobytes(), 4 * plan.window

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(plan.tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for first, texts in W.pieces(batch.column("text")):
                for doc_id, text in zip(batch.column("doc_id").slice(first, len(texts)).to_pylist(), texts.to_pylist(), strict=True):
                    ids = tokens.ids(text or "") + end
                    for at in range(0, len(ids), size):
                        piece = ids[at : at + size]
                        rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.mapInArrow(cut_up, PIECES)


class Levels:
    """Open windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window number, offset) for a piece of this size; of equal choices the fullest window."""
        w, n = self.window, self.count
        new = 2 * n[size] + 1 if size < w else 0
        level = 0
        if size < w:
            # windows at level h = 1 .. w - size go to h + size; one that is then full is open no more
            change = 2 * (n[size + 1 :] - n[1 : w - size + 1]) + 2
            change[-1] -= 1
            usable = np.flatnonzero(n[1 : w - size + 1])
            if len(usable):
                at = len(usable) - 1 - int(np.argmin(change[usable][::-1]))
                if change[usable[at]] <= new:
                    level = int(usable[at]) + 1
        if level:
            window = self.open[level].pop()
            n[level] -= 1
        else:
            window, self.made = self.made, self.made + 1
        if level + size < w:
            self.open[level + size].append(window)
            n[level + size] += 1
        return window, level


def pack(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Add sequence_id and offset to pieces (of at most a window) that are read from a written table."""
    groups = max(1, -(-pieces.count() // plan.group_pieces))
    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("_at", place).withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in W.whole_groups(batches, ["_group"]):
            b = W.bounds(t, ["_group"])
            for x, y in zip(b[:-1], b[1:], strict=True):
                g, levels = t.slice(x, y - x).combine_chunks(), Levels(plan.window)
                at = [levels.place(n) for n in g.column("length").to_pylist()]
                first = g.column("_group")[0].as_py() << 40
                out = g.drop_columns(["_at", "_group"])
                out = out.append_column("sequence_id", pa.array([first + w for w, _ in at], pa.int64())).append_column("offset", pa.array([o for _, o in at], pa.int64()))
                yield from out.to_batches()

    schema = PIECES + ", sequence_id long, offset long"
    return dealt.repartition("_group").sortWithinPartitions("_group", "_at").mapInArrow(packed, schema)


def packed_documents(documents: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = pick(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return pack(cut(tokenised(docs, plan)), plan)


def default_plan() -> Plan:
    import public_tokenizers

    return Plan(public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), default_plan())
