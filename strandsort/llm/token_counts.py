"""Token counts of whole texts by a compiled finite-state tokenizer.

The piece vocabulary is compiled into a deterministic transducer. Byte-pair encoding has a left-to-right form: a sequence
of tokens is the encoding of its text exactly if every two neighbours are the encoding of theirs. So the last token of
each prefix is known as the prefix is read, and a state need only hold the places at which a longer token may still have
begun: for each the trie node reached since, the token before it, and its count of tokens relative to the state's. A
transition reads one character and is annotated with the number of tokens by which the count grows or shrinks. States
and transitions are made when they are first met and kept up to a bound.

No piece has a blank behind another character, and unknown characters (which become their UTF-8 bytes) join nothing; so
the state is the start state before each blank that follows another character, whatever was read before. What is read
from the start state up to such a place is a macro transition: it is kept, with the state behind it, up to a bound.

The state map of a chunk of text leads from states before it to the states behind it and the tokens between; states are
written out, so that maps made in different tasks fit together. Every text is cut into chunks, most into one. Chunks of
longer texts are rows of their own and dealt to all tasks. Each is mapped from every state to which the last ``lead``
characters before it lead from the start state, wherever among the first of them one starts, as many places as the longest
piece has characters. That is one state where these characters have a blank or the state forgets what was before, as
it nearly always does; in a long run of one character or a short pattern it is one for each phase. A map that ends in a
state from which the next chunk is not mapped yet makes it be mapped from there, all of them at once, until none is
missing. Then the scan composes neighbours pairwise: each round joins every second map with the next one and halves their
number, so that a text of n chunks takes log2(n) rounds.

Edge cases: a null text is empty and has no tokens. Repeated rows are counted each. An empty table gives an empty result.
Texts are read whole, in chunks, with or without blanks. Strings of special tokens inside texts are ordinary text. Only ids and texts are read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.llm.common import cut, pick, table

BLANK = "▁"
STRETCH = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Before the first token and after an unknown character.
NONE = ""
#: The places at which a token may have begun: trie node reached since, token before, its count relative to the state's.
State = tuple[tuple[int, str, int], ...]
START: State = ((0, NONE, 0),)


def written(state: State) -> str:
    return json.dumps(state)


def unwritten(text: str) -> State:
    return tuple(tuple(x) for x in json.loads(text))


class Transducer:
    """Counts tokens; states are numbers, state 0 is the start."""

    def __init__(self, pieces: dict[str, float], most_states: int = 200_000, most_counts: int = 300_000):
        self.score, self.most_states, self.most_counts = pieces, most_states, most_counts
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
            raise ValueError("a piece has a blank behind another character")
        self.characters = {c for p in pieces for c in p}
        self.trie: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                at = self.trie[at][c]
            self.token[at] = piece
        self.longest = max(map(len, pieces), default=1)
        self.beside: dict[tuple[str, str], bool] = {}
        self.forget()

    @classmethod
    def of_model(cls, path: str) -> Transducer:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        return cls({p.id_to_piece(i): p.get_score(i) for i in plain})

    def forget(self) -> None:
        self.number, self.states, self.next = {START: 0}, [START], [{}]
        self.known: dict[str, tuple[int, int]] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding of a few characters: the best-scored neighbours join first, of equal ones the leftmost."""
        left = list(text)
        after, alive = list(range(1, len(left) + 1)), [True] * len(left)
        before = list(range(-1, len(left) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(left) and (s := self.score.get(left[i] + left[j])) is not None:
                heapq.heappush(queue, (-s, i, j, left[i] + left[j]))

        for i in range(len(left) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if alive[i] and alive[j] and after[i] == j and left[i] + left[j] == both:
                left[i], alive[j], after[i] = both, False, after[j]
                if after[j] < len(left):
                    before[after[j]] = i
                offer(before[i], i)
                offer(i, after[i])
        return [x for x, a in zip(left, alive, strict=True) if a]

    def beside_each_other(self, a: str, b: str) -> bool:
        if a == NONE:
            a, whole = b, [b]
            b = ""
        else:
            whole = [a, b]
        key = (a, b)
        if key not in self.beside:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            self.beside[key] = self.merge(a + b) == whole
        return self.beside[key]

    def step(self, state: int, c: str) -> tuple[int, int]:
        """Next state and by how much the count changes."""
        if c not in self.characters:
            found = (0, len(c.encode()))
        else:
            open_, last, count = [], None, 0
            for node, before, n in self.states[state]:
                child = self.trie[node].get(c)
                if child is not None:
                    token = self.token[child]
                    if token is not None and last is None and self.beside_each_other(before, token):
                        last, count = token, n + 1
                    if self.trie[child]:
                        open_.append((child, before, n))
            key = (*[(node, before, n - count) for node, before, n in open_], (0, last, 0))
            if key not in self.number:
                self.number[key] = len(self.states)
                self.states.append(key)
                self.next.append({})
            found = (self.number[key], count)
        self.next[state][c] = found
        return found

    def read(self, state: int, stretch: str) -> tuple[int, int]:
        """The state behind a stretch, and by how much the count changes."""
        total = 0
        for c in stretch:
            state, n = self.next[state].get(c) or self.step(state, c)
            total += n
        return state, total

    def macro(self, stretch: str) -> tuple[int, int]:
        """read() from the start state, kept for short stretches."""
        found = self.known.get(stretch)
        if found is None:
            found = self.read(0, stretch)
            if len(stretch) <= 64:
                if len(self.known) >= self.most_counts:
                    self.known.clear()
                self.known[stretch] = found
        return found

    def chunk_map(self, state: State, chunk: str) -> tuple[State, int]:
        """Where a chunk (blanks put as BLANK) leads from a state, and by how much the count changes."""
        if len(self.states) > self.most_states:
            self.forget()
        at, total = self.numbered(state), 0
        after_blank = state[-1][1].endswith(BLANK)
        for stretch in STRETCH.findall(chunk):
            if stretch[0] == BLANK and not after_blank:
                at = 0
            at, n = self.macro(stretch) if at == 0 else self.read(at, stretch)
            total += n
            after_blank = stretch[-1] == BLANK
        return self.states[at], total

    def states_behind(self, lead: str) -> list[State]:
        """The states to which the end of a text leads from the start state, begun at any of its first places."""
        begins = range(min(self.longest, len(lead)))
        if any(lead[p] == BLANK and lead[p - 1] != BLANK for p in range(len(begins), len(lead))):
            begins = range(1)  # all of them are in the start state there
        return list(dict.fromkeys(self.chunk_map(START, lead[k:])[0] for k in begins))

    def numbered(self, state: State) -> int:
        """The number of a state that was written out, here or elsewhere."""
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        return self.number[state]

    def total(self, text: str, chunk: int = 1 << 16) -> int:
        """Tokens of a text, whose chunks' maps are composed one after another."""
        state, total = START, 0
        for part in chunks(text, chunk):
            state, n = self.chunk_map(state, part)
            total += n
        return total


def chunks(text: str, size: int) -> list[str]:
    text = BLANK + text.replace(" ", BLANK) if text else ""
    return [text[i : i + size] for i in range(0, len(text), size)]


@lru_cache(1)
def compiled(model: str) -> Transducer:
    """Kept for the next task in this Python worker."""
    return Transducer.of_model(model)


MAPPED = "row long, doc_id long, n_bytes long, i long, parts long, before string, behind string, n long"


def mapped(pieces: DataFrame, model: str) -> DataFrame:
    """The state maps of pieces (row, doc_id, n_bytes, i, parts, before, lead, chunk): a row for each state before, which is given or else found from the lead."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            at, out = [], []
            for k, (before, lead, chunk) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("before", "lead", "chunk")], strict=True)):
                states = [unwritten(before)] if before else transducer.states_behind(lead.replace(" ", BLANK)) if lead else [START]
                for state in states:
                    at.append(k)
                    out.append((state, *transducer.chunk_map(state, chunk.replace(" ", BLANK))))
            whole = np.asarray(batch.column("parts"))[at] == 1
            states = [pa.array([None if one else written(r[k]) for one, r in zip(whole, out, strict=True)], pa.string()) for k in range(2)]
            kept = batch.select(["row", "doc_id", "n_bytes", "i", "parts"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *states, pa.array([r[2] for r in out], pa.int64())], names=[x.split()[0] for x in MAPPED.split(", ")])

    return pieces.mapInArrow(maps, MAPPED)


def closed(pieces: DataFrame, model: str) -> tuple[DataFrame, int]:
    """mapped() of the pieces of long texts, from all states in which a map of the piece before ends; and in how many rounds."""
    c = F.col
    fresh = maps = cut(mapped(pieces, model))
    rounds = 1
    while True:
        ends = fresh.filter("i + 1 < parts").select(c("row").alias("_row"), (c("i") + 1).alias("_i"), c("behind").alias("_before")).distinct()
        missing = cut(ends.join(maps, (c("row") == c("_row")) & (c("i") == c("_i")) & (c("before") == c("_before")), "left_anti"))
        n = missing.count()
        if not n:
            return maps, rounds
        again = pieces.drop("before").join(F.broadcast(missing) if n <= 100_000 else missing, (c("row") == c("_row")) & (c("i") == c("_i"))).withColumnRenamed("_before", "before").drop("_row", "_i")
        fresh = cut(mapped(again, model))
        maps, rounds = cut(maps.union(fresh)), rounds + 1


def composed(maps: DataFrame) -> tuple[DataFrame, int]:
    """(row, doc_id, n_bytes, n) of each text from its chunks' maps, in so many rounds of joins of neighbours."""
    c = F.col
    most = maps.agg(F.max("parts")).first()[0] or 1
    now, rounds = maps.select("row", "doc_id", "n_bytes", "i", "before", "behind", "n"), 0
    while most > 1:
        right = now.filter("i % 2 = 1").select("row", (c("i") - 1).alias("i"), c("before").alias("behind"), c("behind").alias("_behind"), c("n").alias("_n"))
        both = now.filter("i % 2 = 0").join(right, ["row", "i", "behind"], "left")  # the last one may have no neighbour
        now = both.select("row", "doc_id", "n_bytes", (c("i") / 2).cast("long").alias("i"), "before", F.coalesce("_behind", "behind").alias("behind"), (c("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        most, rounds = -(-most // 2), rounds + 1
        if rounds % 4 == 0:
            now = cut(now)
    return now.filter(c("before") == written(START)).select("row", "doc_id", "n_bytes", "n"), rounds


def token_counts(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = 1 << 16, lead: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than the limit)."""
    c = F.col
    docs = pick(documents, doc_id=id_col, text=text_col)
    # the blank before a text is the tokenizer's; an empty text has none
    whole = F.when(F.length("text") > 0, F.concat(F.lit(BLANK), "text")).otherwise("")
    docs = docs.select(F.monotonically_increasing_id().alias("row"), c("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), whole.alias("text"))
    one = F.lit(None).cast("string").alias("before"), F.lit("").alias("lead")
    short = docs.filter(F.length("text") <= chunk).select("row", "doc_id", "n_bytes", F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("parts"), *one, c("text").alias("chunk"))
    counts = mapped(short, model).select("doc_id", "n_bytes", c("n").alias("n_tokens"))
    long_ = docs.filter(F.length("text") > chunk).withColumn("all", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).drop("text")
    leads = F.concat(F.array(F.lit("")), F.transform("all", lambda x: F.right(x, F.lit(lead))))
    dealt = long_.select("row", "doc_id", "n_bytes", F.size("all").cast("long").alias("parts"), leads.alias("leads"), F.posexplode("all").alias("i", "chunk"))
    dealt = dealt.select("row", "doc_id", "n_bytes", c("i").cast("long").alias("i"), "parts", one[0], F.get("leads", c("i")).alias("lead"), "chunk")
    pieces = cut(dealt.repartition("row", "i"))
    if not pieces.isEmpty():
        whole, _ = composed(closed(pieces, model)[0])
        counts = counts.union(whole.select("doc_id", "n_bytes", c("n").alias("n_tokens")))
    return counts.withColumn("over_limit", c("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
