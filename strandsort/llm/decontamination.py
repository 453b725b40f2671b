"""Benchmark decontamination by a random-walk embedding of edit distance, bit-sampling LSH and exact verification.

Texts are sequences of lower-cased words (runs of ASCII letters and digits and of characters beyond ASCII). An item of n
words contaminates a document if a window of n of its words (or all of them, if it has fewer) is within
floor(max_edits * n) word insertions, deletions and substitutions of the item.

Method. The CGK walk reads a sequence with a pointer: step j copies the word under the pointer and moves on if a random
bit, chosen by j and the word, says so. Two sequences at edit distance d come out at a Hamming distance of O(d^2). Each
repetition draws a walk and a few of its first 3n / 2 steps (on average it reads a word in two); an item and a window
whose sampled words are equal are candidates.
Repetitions are added until items that were edited at random up to the allowed distance are met with the target recall.
Candidates are verified by the exact edit distance.

Only windows that can be near an item are looked at: d edits of a sequence destroy at most 2d of its n - 1 word pairs, so
that a window within reach has at least n - 1 - 2d pairs of that item. This loses no window. The walks miss windows of
which one end is missing, as the pointers part at once; so what they have not met is verified too: every window and item
that pass this filter, in the order of the least distance that their common pairs allow, until no window left can be
nearer than the best one found. The walks find most matches cheaply; the result does not depend on their recall.

The benchmark is dealt into blocks of ``block_words`` words at most. The driver compiles one at a time and broadcasts it,
and the documents are scanned once for each block. Nothing else leaves the executors but matches.

Edge cases: a null or empty text matches nothing, nor does an item without words. A text shorter than an item is one
window. Repeated rows are judged alike. Equal items each match. Only ids and texts are read. An item with more words
than ``block_words`` is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.llm import words as W
from strandsort.llm.common import carry, cut, pick, put_back, table, text_key

PAD = np.uint64(0x5BD1E9955BD1E995)


@dataclass(frozen=True)
class Search:
    max_edits: float = 0.2
    #: Words sampled from an embedding.
    sampled: int = 2
    target_recall: float = 0.999
    #: Lengths that would need more walks get so many; what those miss is found by the exact filter and verification alone.
    walks: int = 256
    #: Edited copies of items, on which the recall is measured.
    trials: int = 400
    block_words: int = 200_000
    seed: int = 17

    def reach(self, n: int) -> int:
        return int(self.max_edits * n)


class Walks:
    """Random choices of some repetitions for sequences of n words: the bits of the walks and the steps that are sampled."""

    def __init__(self, n: int, repetitions: int, search: Search):
        self.n = n
        draws = [np.random.default_rng((search.seed, n, r)) for r in range(repetitions)]
        inside = max(1, 3 * n // 2)  # later steps mostly read behind the end, where all sequences agree
        m = min(search.sampled, inside)
        self.steps = np.sort(np.stack([g.choice(inside, m, replace=False) for g in draws]), axis=1)
        self.turns = np.stack([g.integers(1, 1 << 63, 3 * n, np.uint64) for g in draws]) | np.uint64(1)

    def keys(self, seq: np.ndarray) -> np.ndarray:
        """(repetitions, rows): one hash of the sampled steps of each row's embedding; seq has n columns, PAD behind the last word."""
        rows, reps = len(seq), len(self.steps)
        wide = np.concatenate([seq, np.full((rows, 1), PAD)], axis=1).ravel()
        by_last = np.argsort(-self.steps[:, -1], kind="stable")  # walks that have made their last step are at the end, and are left
        steps, turns = self.steps[by_last], self.turns[by_last]
        begin = np.arange(rows) * (self.n + 1)
        at, end = np.repeat(begin[None, :], reps, axis=0), begin + self.n
        out = np.repeat(by_last.astype(np.uint64)[:, None], rows, axis=1)
        sampled: dict[int, list[int]] = {}
        for r, of in enumerate(steps.tolist()):
            for j in of:
                sampled.setdefault(j, []).append(r)
        going = np.searchsorted(-steps[:, -1], -np.arange(int(steps.max()) + 1), "right").tolist()
        for j, n in enumerate(going):
            here = at[:n]
            word = wide.take(here, mode="clip")
            if r := sampled.get(j):
                out[r] = W.mix(out[r] ^ word[r]) * np.uint64(0x9E3779B97F4A7C15)
            word *= turns[:n, j : j + 1]
            word >>= np.uint64(63)
            here += word.view(np.int64)
            np.minimum(here, end, out=here)
        keys = np.empty_like(out)
        keys[by_last] = out
        return keys


def edit_distances(a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int | None = None) -> np.ndarray:
    """Exact word edit distances of the rows of a (size words each, then PAD) and of b (all of its columns), a table row at a time.

    What is more than ``most`` may come out as any number above it.
    """
    if 0 < b.shape[1] <= 64 and len(a):
        return bit_distances(a, b, size, b.shape[1] + a.shape[1] if most is None else most)
    kind = np.int16 if a.shape[1] + b.shape[1] < 30_000 else np.int64
    n, span = b.shape[1], np.arange(b.shape[1] + 1, dtype=kind)
    line = np.repeat(span[None, :], len(a), axis=0)
    out = np.where(size == 0, n, 0)
    for i in range(a.shape[1]):
        best = np.minimum(line[:, 1:] + 1, line[:, :-1] + (b != a[:, i : i + 1]))
        line = np.minimum.accumulate(np.concatenate([np.full((len(a), 1), i + 1, kind), best], axis=1) - span, axis=1) + span
        out[size == i + 1] = line[size == i + 1, n]
    return out


def bit_distances(a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """edit_distances() for up to 64 columns of b: a table row is two words of bits, where it rises and where it falls (Myers, Hyyro).

    A row that can't come down to ``most`` with the words left is given up.
    """
    one, n = np.uint64(1), b.shape[1]
    last = np.uint64(n - 1)
    out, left = np.where(size == 0, n, most + 1), np.flatnonzero(size > 0)
    a, b, size = a[left], np.broadcast_to(b, (len(out), n))[left], size[left]
    up, down, score = np.full(len(left), ~np.uint64(0)), np.zeros(len(left), np.uint64), np.full(len(left), n)
    bits = np.zeros((len(left), 8), np.uint8)
    for i in range(a.shape[1]):
        packed = np.packbits(b == a[:, i : i + 1], axis=1, bitorder="little")
        bits[:, : packed.shape[1]] = packed
        equal = bits.view(np.uint64)[:, 0]
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(across | up), up & across
        score += ((rise >> last) & one).view(np.int64) - ((fall >> last) & one).view(np.int64)
        rise, fall = (rise << one) | one, fall << one
        up, down = fall | ~(vertical | rise), rise & vertical
        done = size == i + 1
        out[left[done]] = score[done]
        able = ~done & (score - (size - i - 1) <= most)
        if 4 * np.count_nonzero(able) < 3 * len(able):
            left, a, b, size, up, down, score, bits = (x[able] for x in (left, a, b, size, up, down, score, bits))
            if not len(left):
                break
    return out


@dataclass
class Items:
    """The items of one length n: ids, words, and their keys in all repetitions, sorted, with the items they are of."""

    n: int
    ids: np.ndarray
    seq: np.ndarray
    walks: Walks
    keys: np.ndarray
    owner: np.ndarray


def pair_hash(h: np.ndarray) -> np.ndarray:
    return W.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def enough_repetitions(seq: np.ndarray, n: int, search: Search) -> int:
    """Twice the repetitions after which the share of randomly edited items that were met reaches the target, or all walks.

    This decides who finds a window, not whether it is found: verify_rest() looks at all that the walks have not met.
    """
    if not search.reach(n):
        return 1
    rng = np.random.default_rng((search.seed, n))
    which = rng.integers(0, len(seq), search.trials)
    edited = np.full((search.trials, n), PAD)
    for t, w in enumerate(which):
        s = list(seq[w])
        for kind in rng.integers(0, 3, search.reach(n)):
            at = int(rng.integers(len(s))) if s else 0
            if kind != 1:
                s.insert(at, np.uint64(rng.integers(1 << 62)))
            if kind != 0 and s:
                del s[min(at + int(kind == 2), len(s) - 1)]
        edited[t, : min(n, len(s))] = s[:n]
    tries = 8
    while True:
        walks = Walks(n, tries, search)
        met = np.logical_or.accumulate(walks.keys(edited) == walks.keys(seq)[:, which], axis=0).mean(axis=1)
        if met[-1] >= search.target_recall or tries >= search.walks:
            return min(search.walks, 2 * int(np.searchsorted(met, search.target_recall) + 1))
        tries *= 2


def compile_items(ids: list[int], texts: list[str], search: Search) -> list[Items]:
    h, _, _, first = W.words(pa.array(texts, pa.string()), inside=W.ALNUM)
    count, out = np.diff(first), []
    for n in sorted(set(count[count > 0].tolist())):
        who = np.flatnonzero(count == n)
        seq = np.stack([h[first[i] : first[i + 1]] for i in who])
        walks = Walks(n, enough_repetitions(seq, n, search), search)
        keys = walks.keys(seq)
        order = np.argsort(keys.ravel(), kind="stable")
        out.append(Items(n, np.array(ids)[who], seq, walks, keys.ravel()[order], np.tile(np.arange(len(who)), len(keys))[order]))
    return out


class Pairs:
    """Word pairs of all items and, for each length, the items that have it. A bit table spares most look-ups."""

    def __init__(self, compiled: list[Items], size: int = 1 << 22):
        have = [[pair_hash(s) for s in i.seq] if i.n > 1 else [] for i in compiled]
        self.values = np.unique(np.concatenate([v for h in have for v in h] or [np.zeros(1, np.uint64)]))
        self.which, self.item = [], []
        self.of = np.zeros((len(compiled), len(self.values)), bool)
        for c, h in enumerate(have):
            which = np.searchsorted(self.values, np.concatenate(h or [np.zeros(0, np.uint64)]))
            item = np.repeat(np.arange(len(h)), [len(v) for v in h])
            which, item = np.unique(np.stack([which, item]), axis=1)
            self.of[c, which] = True
            self.which.append(which)
            self.item.append(item)
        self.mask = np.uint64(size - 1)
        self.bits: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"bits": None}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes are known pairs, and which."""
        if self.bits is None:
            self.bits = np.zeros(int(self.mask) + 1, bool)
            self.bits[(self.values & self.mask).astype(np.int64)] = True
        at = np.flatnonzero(self.bits[(h & self.mask).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        known = self.values[which] == h[at]
        return at[known], which[known]

    def of_items(self, c: int, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of all pairs that items of length number c have, sorted."""
        at, which = at[self.of[c, which]], which[self.of[c, which]]
        a, z = np.searchsorted(self.which[c], which, "left"), np.searchsorted(self.which[c], which, "right")
        item, place = self.item[c][spread(a, z)], np.repeat(at, z - a)
        order = np.lexsort((place, item))
        return item[order], place[order]


def spread(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """a[0] .. z[0] - 1, a[1] .. z[1] - 1 and so on."""
    times = z - a
    return np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def windows_within_reach(first: np.ndarray, doc: np.ndarray, item: np.ndarray, place: np.ndarray, items: int, n: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, item, least distance) of the windows of n words, and of shorter texts as a whole, with n - 1 - 2d or more pairs of an item."""
    least, span = n - 1 - 2 * d, len(doc) + n
    own = item * span + place
    if least < 1:
        found = (np.arange(items if d else 1)[:, None] * span + np.arange(len(doc))[None, :]).ravel()  # single words: equal keys are equal words
    else:
        # pairs k .. k + least - 1 lie in a window if they span n - 2 places or fewer
        k = np.arange(max(0, len(own) - least + 1))
        k = k[(item[k] == item[k + least - 1]) & (place[k + least - 1] - place[k] <= n - 2)]
        low, high = np.maximum(0, place[k + least - 1] - (n - 2)), place[k]
        found = np.unique(spread(item[k] * span + low, item[k] * span + high + 1))
    which, starts = found // span, found % span
    begin, end = first[doc[starts]], first[doc[starts] + 1]
    inside = (starts + n <= end) | ((starts == begin) & (end - begin < n))
    found, which, starts = found[inside], which[inside], starts[inside]
    have = np.searchsorted(own, which * span + np.minimum(starts + n, end[inside]) - 1) - np.searchsorted(own, found)
    return starts, which, np.maximum(0, -(-(n - 1 - have) // 2))


FOUND = ("doc_id", "key", "item_id", "start", "end", "edits")


def matches(documents: DataFrame, compiled: list[Items], search: Search) -> DataFrame:
    """(doc_id, key, item_id, start, end, edits): character span, in the lower-cased text, of the best window of each document and item."""
    # one block of items, bounded by block_words; a Python worker reads it once for all of its tasks
    held = documents.sparkSession.sparkContext.broadcast((compiled, Pairs(compiled)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, pairs = held.value
        short = any(i.n - 1 - 2 * search.reach(i.n) < 1 for i in compiled)
        for batch in batches:
            lowered = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
            near: list[list[tuple]] = [[] for _ in compiled]
            able: list[list[tuple]] = [[] for _ in compiled]
            known = [0] * len(compiled)
            for base, texts in W.pieces(lowered):
                h, s, e, first = W.words(texts, lower=False, inside=W.ALNUM)
                if not len(h):
                    continue
                doc, off = np.repeat(np.arange(len(texts)), np.diff(first)), W.flat(texts)[1]
                at, which = pairs.find(pair_hash(h))
                inside = doc[at] == doc[at + 1]
                at, which = at[inside], which[inside]
                if not short and not len(at):
                    continue
                for c, items in enumerate(compiled):
                    begins, item, least = windows_within_reach(first, doc, *pairs.of_items(c, at, which), len(items.ids), items.n, search.reach(items.n))
                    if len(begins):
                        starts, of = np.unique(begins, return_inverse=True)
                        d = doc[starts]
                        size = np.minimum(items.n, first[d + 1] - starts)
                        place = np.minimum(starts[:, None] + np.arange(items.n)[None, :], len(h) - 1)
                        seq = np.where(np.arange(items.n)[None, :] < size[:, None], h[place], PAD)
                        near[c].append((seq, size, d + base, s[starts] - off[d], e[starts + size - 1] - off[d]))
                        able[c].append((of + known[c], item, least))
                        known[c] += len(starts)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for items, windows, left in zip(compiled, near, able, strict=True):
                if windows:
                    told = [np.concatenate(x) for x in zip(*windows, strict=True)]
                    compare(*told, items, search, best)
                    if search.reach(items.n):
                        verify_rest(*told, *[np.concatenate(x) for x in zip(*left, strict=True)], items, search, best)
            rows = []
            for (d, item), (edits, a, z) in best.items():
                text = lowered[d].as_py().encode()
                rows.append((batch.column("doc_id")[d].as_py(), batch.column("key")[d].as_py(), item, len(text[:a].decode()), len(text[:z].decode()), edits))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FOUND))], names=list(FOUND))

    return documents.mapInArrow(found, ", ".join(f"{x} long" for x in FOUND))


def compare(seq: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, items: Items, search: Search, best: dict) -> None:
    """Put into best, for each document and item, the fewest edits and the bytes of the first such window."""
    for lo in range(0, len(seq), 2048):
        keys = items.walks.keys(seq[lo : lo + 2048])
        a, z = np.searchsorted(items.keys, keys, "left"), np.searchsorted(items.keys, keys, "right")
        r, w = np.nonzero(z > a)
        times = (z - a)[r, w]
        owner = items.owner[spread(a[r, w], z[r, w])]
        tried = np.unique(np.stack([np.repeat(w, times) + lo, owner]), axis=1)
        w, i = tried
        equal = (seq[w] == items.seq[i]).all(axis=1)
        note(best, doc, start, end, items, w[equal], i[equal], np.zeros(int(equal.sum()), int))
        exact = np.array([best.get((int(doc[x]), int(items.ids[y])), (1,))[0] == 0 for x, y in zip(w, i, strict=True)], bool)
        w, i = w[~exact], i[~exact]  # nothing is nearer than a copy
        for k in range(0, len(w), 4096):
            x, y = w[k : k + 4096], i[k : k + 4096]
            edits = edit_distances(seq[x], items.seq[y], size[x], search.reach(items.n))
            near = edits <= search.reach(items.n)
            note(best, doc, start, end, items, x[near], y[near], edits[near])


def verify_rest(
    seq: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, w: np.ndarray, i: np.ndarray, least: np.ndarray, items: Items, search: Search, best: dict
) -> None:
    """As compare(), for the windows w and items i whose distance, least or more, may be less than the best one known."""
    reach = search.reach(items.n)
    _, to = np.unique(np.stack([doc[w], items.ids[i]]), axis=1, return_inverse=True)
    to = to.ravel()
    edits, first = np.full(to.max(initial=-1) + 1, reach), np.full(to.max(initial=-1) + 1, np.iinfo(np.int64).max)
    for k, x, y in zip(*[v.tolist() for v in firsts(to, w, i)], strict=True):
        if (have := best.get((int(doc[x]), int(items.ids[y])))) is not None:
            edits[k], first[k] = have[:2]
    open_ = lambda k: (least[k] < edits[to[k]]) | ((least[k] == edits[to[k]]) & (start[w[k]] < first[to[k]]))
    rest = np.lexsort((start[w], least))
    rest, step, some = rest[open_(rest)], max(64, 4_000_000 // items.n), 2
    while len(rest):
        # of each document and item the most hopeful windows first, a few at a time, as they may settle the others
        turn = np.argsort(to[rest], kind="stable")
        rank = np.empty(len(rest), np.int64)
        begin = np.flatnonzero(np.diff(to[rest][turn], prepend=-1))
        rank[turn] = np.arange(len(rest)) - np.repeat(begin, np.diff(np.append(begin, len(rest))))
        now = np.zeros(len(rest), bool)
        now[np.flatnonzero(rank < some)[:step]] = True
        some *= 4
        x, y, k = w[rest[now]], i[rest[now]], to[rest[now]]
        got = edit_distances(seq[x], items.seq[y], size[x], reach)
        near = got <= reach
        note(best, doc, start, end, items, x[near], y[near], got[near])
        for a, b, c in zip(k[near].tolist(), x[near].tolist(), y[near].tolist(), strict=True):
            edits[a], first[a] = best[(int(doc[b]), int(items.ids[c]))][:2]
        rest = rest[~now]
        rest = rest[open_(rest)]


def firsts(to: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The values of to, and for each the columns' entries where it stands first."""
    values, at = np.unique(to, return_index=True)
    return values, *[c[at] for c in columns]


def note(best: dict, doc: np.ndarray, start: np.ndarray, end: np.ndarray, items: Items, w: np.ndarray, i: np.ndarray, edits: np.ndarray) -> None:
    for x, y, n in zip(w.tolist(), i.tolist(), edits.tolist(), strict=True):
        to, new = (int(doc[x]), int(items.ids[y])), (n, int(start[x]), int(end[x]))
        if to not in best or new < best[to]:
            best[to] = new


def blocks(benchmark: DataFrame, search: Search) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of at most block_words words, by a running sum of the counts of id-hash bins."""
    items = pick(benchmark, item_id="item_id", text="text").filter("text IS NOT NULL")
    items = items.withColumn("_n", F.size(F.split("text", r"[^\p{L}\p{N}]+")))
    total = items.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, -(-2 * total // search.block_words)) if total > search.block_words else 1
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def keyed_matches(documents: DataFrame, benchmark: DataFrame, search: Search) -> DataFrame:
    """contaminated() with each document's text_key()."""
    docs = pick(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", text_key("text"))
    out = None
    for ids, texts in blocks(benchmark, search):
        if compiled := compile_items(ids, texts, search):
            part = matches(docs, compiled, search)
            out = part if out is None else out.union(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], ", ".join(f"{x} long" for x in FOUND))
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """(doc_id, item_id, start, end, edits), one row for each document and each item that it contains."""
    return keyed_matches(documents, benchmark, search).drop("key")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, search: Search = Search(), broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents that contain no item. Rows are told apart by id and text together: null and repeated ids are ids like any others."""
    found = cut(keyed_matches(documents, benchmark, search).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct())
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    rows = carry(documents, doc_id="doc_id", text="text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_key("text") == F.col("_key"))
    return rows.join(found, same, "left_anti").select(*put_back(documents.columns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "edits")
