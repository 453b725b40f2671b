"""Word and shingle hashes of whole Arrow batches of text, with numpy only: used inside tasks.

A word's hash is a polynomial over its UTF-8 bytes modulo 2**64, taken from one running sum over the batch, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NOT_BLANK = ~BLANK
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(1 << 19, 1 << n.bit_length()), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def pieces(texts: pa.Array, most_bytes: int = 500_000) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``most_bytes``, with the index of their first row. A longer text is a slice of its own."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)) if len(texts) else np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets (n + 1) of each; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def words(texts: pa.Array, lower: bool = True, inside: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, their first bytes and ends, and for each text the index of its first word (n + 1)."""
    if lower:
        texts = pc.utf8_lower(texts)
    data, off = flat(texts)
    isw = inside[data]
    start, end = isw.copy(), isw.copy()
    start[1:] &= ~isw[:-1]
    end[:-1] &= ~isw[1:]
    if len(data):
        a = off[:-1][off[:-1] < len(data)]
        start[a] = isw[a]
        b = off[1:][off[1:] > 0] - 1
        end[b] = isw[b]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    h = mix((sums[e] - sums[s]) * powers(_INVERSE, len(data) + 1)[s]) if len(s) else np.zeros(0, np.uint64)
    return h, s, e, np.searchsorted(s, off)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words, and the offsets for each text; a text of 1 to n - 1 words has one window."""
    count = np.diff(first)
    windows = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(windows)])
    at = np.arange(off[-1]) - np.repeat(off[:-1] - first[:-1], windows)
    last = np.repeat(first[1:], windows)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = at + k < last
        out[there] += h[(at + k)[there]] * np.uint64(_ODD[k])
        if not there.all():
            out[~there] += np.uint64(k + 1)
    return mix(out), off


_ODD = [int(x) | 1 for x in np.random.default_rng(5).integers(1 << 62, 1 << 63, 64)]


def sequence_digest(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit digest of each text's words in their order."""
    base = 0xD1342543DE82EF95
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(0x632BE59BD9B4E019)) * powers(base, len(h)), out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(h) + 1)
    d = (sums[first[1:]] - sums[first[:-1]]) * inverse[first[:-1]]
    return mix(d + np.diff(first).astype(np.uint64) * np.uint64(_BASE))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = np.asarray(batch.column(k))
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= v[0] != np.asarray(held[-1].column(k))[-1]
        at = int(np.flatnonzero(change)[-1]) if change.any() else None
        if at is None:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, at)] if at else held
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, with its length at the end."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        v = np.asarray(table.column(k))
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def roots(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n nodes the node of least rank that the links a-b connect it with."""
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    label, x, y = np.arange(n), place[a], place[b]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return order[label][place]
        label = new
