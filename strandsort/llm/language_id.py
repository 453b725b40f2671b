"""Language identification by blended-spectrum string kernels, Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the share of common character n-grams (n = 1 to 3, each counted once, over a folded alphabet):
|G(x) & G(z)| / sqrt(|G(x)| |G(z)|). Landmarks span the feature space: phi(x) = k(x, landmarks) K^(-1/2). One ridge
regression for each language, fitted on a bounded sample of labelled texts, scores a batch by one matrix product.

The fit uses about ``fit_rows`` labelled texts (a documented bound), shared out among all languages, and ``landmarks`` of
them; no label is left out, however many there are. n-grams are of characters. Every text is predicted, whole. What goes to the tasks are the landmarks' n-gram tables and the weights, whose size depends on these
parameters and the number of labels.

Edge cases: a null text or one without a letter is ``und`` with score 0. Rows without a label are no examples. With no
labelled rows at all every text is ``und``. Repeated rows are predicted alike; an empty table gives an empty result. Only
id, text and label are read, the label for the fit alone. A row without id is learned from and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.llm import words as W
from strandsort.llm.common import pick, table

BITS = 6
ORDERS = (1, 2, 3)
#: Offsets of the codes of each order in one table.
BASE = {n: sum(1 << (BITS * k) for k in ORDERS if k < n) for n in ORDERS}
CODES = sum(1 << (BITS * n) for n in ORDERS)

#: Letters a to z are 1 to 26, other ASCII characters 0; characters beyond ASCII are hashed to 27 to 63.
FOLD = np.zeros(128, np.int64)
FOLD[97:123] = np.arange(1, 27)


@dataclass(frozen=True)
class Settings:
    #: Labelled texts for the fit, shared out among the languages, ``least_rows`` each at least.
    fit_rows: int = 2400
    least_rows: int = 4
    landmarks: int = 192
    ridge: float = 0.1
    seed: int = 5


@dataclass
class Model:
    languages: list[str]
    #: For each n-gram code its column among the landmarks' n-grams, or -1.
    column: np.ndarray
    #: (n-grams, landmarks), scaled by the landmarks' sizes.
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), self.grams.shape[0]), np.float32)
        for i, s in enumerate(sets):
            c = self.column[s]
            x[i, c[c >= 0]] = 1 / np.sqrt(len(s))
        return x @ self.grams @ self.weights + self.bias


_seen = np.zeros(CODES, np.int64)


def folded(points: np.ndarray) -> np.ndarray:
    """The code of each character."""
    mixed = (points * np.uint32(2654435769)) >> np.uint32(16)
    return np.where(points < 128, FOLD[np.minimum(points, 127)], 27 + (mixed % np.uint32(37)).astype(np.int64))


def gram_set(c: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that occur in the folded characters, each once."""
    all_ = [c + BASE[1]]
    code = c
    for n in ORDERS[1:]:
        code = (code[:-1] << BITS) | c[n - 1 :] if len(code) > 1 else code[:0]
        all_.append(code + BASE[n])
    codes = np.concatenate(all_)
    at = np.arange(len(codes))
    _seen[codes] = at
    return codes[_seen[codes] == at]


def gram_sets(texts: pa.Array) -> list[np.ndarray]:
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    points = folded(np.frombuffer(W.flat(low)[0].tobytes().decode().encode("utf-32-le"), np.uint32))
    off = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(low), np.int64))])
    return [gram_set(points[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most 256 texts and about two megabytes of them; a longer text is a slice of its own."""
    for k in range(0, batch.num_rows, 256):
        some = batch.slice(k, 256)
        for at, texts in W.pieces(some.column("text"), 2_000_000):
            yield some.slice(at, len(texts))


def fit(sets: list[np.ndarray], labels: list[str], settings: Settings) -> Model:
    languages, rng = sorted(set(labels)), np.random.default_rng(settings.seed)
    y = np.array([languages.index(x) for x in labels])
    # as many of each language as there is room for: first one of each in random turn, then another
    turn = rng.permutation(len(y))
    rank = np.empty(len(y), np.int64)
    for k in range(len(languages)):
        own = turn[y[turn] == k]
        rank[own] = np.arange(len(own))
    marks = turn[np.argsort(rank[turn], kind="stable")][: settings.landmarks]
    known = np.unique(np.concatenate([sets[i] for i in marks]))
    column = np.full(CODES, -1, np.int32)
    column[known] = np.arange(len(known))
    grams = np.zeros((len(known), len(marks)), np.float32)
    for j, i in enumerate(marks):
        grams[column[sets[i]], j] = 1 / np.sqrt(len(sets[i]))
    model = Model(languages, column, grams, np.eye(len(marks), dtype=np.float32), np.zeros(1, np.float32))
    kernel = np.concatenate([model.scores(sets[k : k + 512]) for k in range(0, len(sets), 512)]).astype(float)
    value, vector = np.linalg.eigh((kernel[marks] + kernel[marks].T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = kernel @ root
    mean = phi.mean(axis=0)
    # each language weighs the same, however many of the examples are its own
    weight = (1 / np.bincount(y, minlength=len(languages)))[y][:, None]
    target = (y[:, None] == np.arange(len(languages))).astype(float)
    phi_c, goal = phi - mean, target.mean(axis=0)
    w = np.linalg.solve(phi_c.T @ (weight * phi_c) + settings.ridge / len(sets) * np.eye(phi.shape[1]), phi_c.T @ (weight * (target - goal)))
    model.weights, model.bias = (root @ w).astype(np.float32), (goal - mean @ w).astype(np.float32)
    return model


def remainder(doc_id: Column) -> Column:
    """A null id counts as an empty text: such rows are learned from, and not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def examples(documents: DataFrame, settings: Settings) -> tuple[list[np.ndarray], list[str]]:
    """n-gram sets and labels of a sample of the labelled rows; every label is learned."""
    labelled = documents.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.groupBy("lang").count().collect()  # a row a label, as in the model's own class table
    if not counts:
        return [], []
    share = max(settings.least_rows, settings.fit_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, share / r["count"])))])
    chosen = labelled.filter(draw < F.coalesce(F.try_element_at(rate, F.col("lang")), F.lit(0.0)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch)):
            sets = gram_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([s.astype(np.int32) for s in sets], pa.list_(pa.int32()))], names=["lang", "grams"])

    rows = chosen.select("lang", "text").mapInArrow(grams, "lang string, grams array<int>").filter("size(grams) > 0").toArrow()
    order = sorted(range(rows.num_rows), key=lambda i, g=rows.column("grams").to_pylist(), y=rows.column("lang").to_pylist(): (y[i], g[i]))
    g, y = rows.column("grams").to_pylist(), rows.column("lang").to_pylist()
    return [np.array(g[i], np.int64) for i in order], [y[i] for i in order]


def languages(documents: DataFrame, training: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred and score for every row of documents; training has doc_id, text and lang."""
    sets, labels = examples(training, settings)
    model = fit(sets, labels, settings) if labels else None

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                if model is None:
                    best, top = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    scores = model.scores([s if len(s) else np.zeros(1, np.int64) for s in gram_sets(part.column("text"))])
                    best, top = [model.languages[i] for i in scores.argmax(axis=1)], scores.max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lettered"), pa.array(best, pa.string()), pa.array(np.clip(top.astype(float), 0, 1))], names=["doc_id", "lettered", "lang_pred", "score"])

    docs = documents.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    raw = docs.mapInArrow(predicted, "doc_id long, lettered boolean, lang_pred string, score double")
    return raw.select("doc_id", F.when(F.col("lettered"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    training = docs.filter(remainder(F.col("doc_id")) != 2)
    return languages(docs.select("doc_id", "text"), training).select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
