"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a predicate that a good document meets, over statistics of the text. ``order_rules`` measures on a bounded
sample what each rule costs with the statistics that it needs, and which rules each row fails; it then puts first the
rule with the most rejections per cost, next the one with the most among the rows that are left, and so on. The verdict
does not depend on the order, only the work does.

``keep_good`` runs the cascade: the statistics of a rule are computed only for rows that no earlier rule has rejected, so
that most bad rows never get to the costly ones. ``judge`` reports the base statistics of every row, as they are asked
for; there the cascade spares what only its rules need.

Costs are the least of several short runs on the sample, as halvings of the dearest one's, so that the order does not
change from run to run with the machine's load.

Edge cases: a null text counts as empty and fails the base rules, as does any text of fewer than 50 words. Texts are read
whole. Equal rows get equal results, row by row. An empty table gives an empty result. Only the id and text columns are
read, and the others are carried in one struct, so that no name can clash.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.llm.common import behind_barrier, carry, pick, put_back, table

#: Fixed values of the base statistics.
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def length_without(pattern: str) -> Column:
    return F.length(F.regexp_replace("text", pattern, ""))


def windows() -> Column:
    """64-bit hashes of all windows of words."""
    last = (F.col("n_words") - (WINDOW - 1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[F.element_at("words", (i + k).cast("int")) for k in range(WINDOW)]))
    return F.when(F.col("n_words") > WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def ordered(worth: Column) -> Column:
    """The sorted (hash, place) of the windows of texts for which it is worth while; equal windows are neighbours."""
    return F.when(worth, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def covered(windows: str) -> Column:
    """Words in windows that occur twice or more."""
    other = lambda s, k: F.coalesce(s["h"] == F.get(windows, k)["h"], F.lit(False))
    twins = F.filter(windows, lambda s, k: other(s, k - 1) | other(s, k + 1))
    places = F.flatten(F.transform(twins, lambda s: F.array(*[s["i"] + k for k in range(WINDOW)])))
    return F.when(F.col(windows).isNotNull(), F.size(F.array_distinct(places))).otherwise(0).cast("long")


#: Each statistic with those that it is made of; ``text`` is never null here.
STATISTICS = {
    "words": ((), lambda: F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")),
    "n_words": (("words",), lambda: F.size("words").cast("long")),
    "windows": (("words", "n_words"), windows),
    "n_again": (("windows",), lambda: F.size("windows") - F.size(F.array_distinct("windows"))),
    "sorted": (("n_again",), lambda: ordered(F.col("n_again") > 0)),
    "n_repeat_words": (("sorted",), lambda: covered("sorted")),
    # n_again windows too many are part of at most twice as many that repeat, which have WINDOW words each: 0 if that can't matter
    "sorted_if_many": (("n_again",), lambda: ordered(100 * 2 * WINDOW * F.col("n_again") > MAX_REPEAT_PERCENT * F.col("n_words"))),
    "n_repeat_words_if_many": (("sorted_if_many",), lambda: covered("sorted_if_many")),
    "lines": ((), lambda: F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))),
    "n_lines": (("lines",), lambda: F.size("lines").cast("long")),
    "n_dup_lines": (("lines",), lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")),
    "word_chars": (("words",), lambda: F.length(F.array_join("words", "")).cast("long")),
    "n_symbols": ((), lambda: (F.length("text") - length_without(SYMBOLS)).cast("long")),
    "n_upper": ((), lambda: length_without("[^A-Z]+").cast("long")),
    "n_lettered": (("words",), lambda: F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long")),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``passes``: an SQL predicate over the statistics that it ``needs`` and ``text``; null counts as failed."""

    name: str
    passes: str
    needs: tuple[str, ...] = ()


#: The two halves of the base rule.
BASE_RULES = (
    Rule("enough_words", f"n_words >= {MIN_WORDS}", ("n_words",)),
    Rule("few_repeats", f"100 * n_repeat_words_if_many <= {MAX_REPEAT_PERCENT} * n_words", ("n_repeat_words_if_many", "n_words")),
)
#: Beside the base rules. A clean text passes all of them, in any of the languages.
RULES = (
    Rule("mean_word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", ("word_chars", "n_words")),
    Rule("symbols_per_word", "10 * n_symbols <= n_words", ("n_symbols", "n_words")),
    Rule("duplicate_lines", "2 * n_dup_lines <= n_lines", ("n_dup_lines", "n_lines")),
    Rule("shouting", "n_upper * 10 <= word_chars * 3", ("n_upper", "word_chars")),
    Rule("words_with_letters", "n_lettered * 10 >= n_words * 8", ("n_lettered", "n_words")),
)


def with_statistics(df: DataFrame, names: tuple[str, ...], wanted: Column | None = None) -> DataFrame:
    """Add the statistics and what they are made of, where they are not there yet; null for rows that are not ``wanted``.

    Repeats are found inside the row. Each step is a projection of its own, whose values the next one uses.
    """
    for name in names:
        if name not in df.columns:
            parts, make = STATISTICS[name]
            df = with_statistics(df, parts, wanted)
            df = df.withColumn(name, make() if wanted is None else F.when(wanted, make()))
    return df


@dataclass(frozen=True)
class Measured:
    """A rule with its cost (in costs of the dearest) and the share it rejects of what the rules before it leave."""

    rule: Rule
    cost: float
    rejects: float


def by_rank(rules: tuple[Rule, ...], cost: list[float], verdicts: list[tuple[int, int]]) -> list[Measured]:
    """Greedy order by rejections per cost among the rows left; verdicts are (bits of the failed rules, rows)."""
    left, out = dict(enumerate(rules)), []
    while left:
        total = sum(n for _, n in verdicts)
        failed = {i: sum(n for bits, n in verdicts if bits >> i & 1) for i in left}
        best = min(left, key=lambda i: (-failed[i] / cost[i], cost[i], i))
        out.append(Measured(left.pop(best), cost[best], failed[best] / total if total else 0.0))
        verdicts = [(bits, n) for bits, n in verdicts if not bits >> best & 1]
    return out


def drawn(text: DataFrame, fraction: float, seed: int) -> DataFrame:
    """A sample in one partition, so that runs on it are timed alike. It is shuffled there: all tasks read the table, and only the sample's rows meet."""
    return text.sample(fraction=fraction, seed=seed).repartition(1)


def order_rules(documents: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, sample_rows: int = 2000, runs: int = 2, seed: int = 7) -> list[Measured]:
    """The rules in the order in which they should run, measured on a sample of about ``sample_rows`` rows of (text)."""
    text = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    total = text.count()
    if not total:
        return [Measured(r, 1.0, 0.0) for r in rules]
    sample = drawn(text, min(1.0, sample_rows / total), seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fails = lambda r: ~F.coalesce(F.expr(r.passes), F.lit(False))
        bits = sum((F.when(fails(r), 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
        needs = tuple(dict.fromkeys(x for r in rules for x in r.needs))
        verdicts = [tuple(v) for v in with_statistics(sample, needs).groupBy(bits.alias("bits")).count().collect()]

        def seconds(rule: Rule | None) -> float:
            plan = sample.agg(F.max(F.length("text"))) if rule is None else with_statistics(sample, rule.needs).agg(F.count_if(fails(rule)))
            plan.collect()
            best = math.inf
            for _ in range(runs):
                began = time.perf_counter()
                plan.collect()
                best = min(best, time.perf_counter() - began)
            return best

        idle = seconds(None)
        spent = [max(2e-3, seconds(r) - idle) for r in rules]
    finally:
        sample.unpersist()
    return by_rank(rules, [2.0 ** max(-6, round(math.log2(s / max(spent)))) for s in spent], verdicts)


def cascade(df: DataFrame, turns: list[Measured], failed: str) -> DataFrame:
    """Add ``failed``, the name of the first rule that a row fails, or null; statistics are computed where no rule has failed yet."""
    df = df.withColumn(failed, F.lit(None).cast("string"))
    for m in turns:
        df = with_statistics(df, m.rule.needs, F.col(failed).isNull())
        passes = F.coalesce(F.expr(m.rule.passes), F.lit(False))
        df = df.withColumn(failed, F.when(F.col(failed).isNotNull(), F.col(failed)).when(~passes, F.lit(m.rule.name)))
    return df


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """doc_id, text (null as empty), the base statistics, base_failed, failed_rule (the first in the cascade's order) and kept."""
    docs = pick(documents, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    turns = order_rules(docs, BASE_RULES + rules, sample_rows)
    based = with_statistics(docs, BASE).withColumn("n_repeat_words_if_many", F.col("n_repeat_words"))
    based = based.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    judged = cascade(based, turns, "failed_rule").withColumn("kept", F.col("failed_rule").isNull())
    return behind_barrier(judged.select("doc_id", "text", *BASE, "base_failed", "failed_rule", "kept"), keep=["doc_id", "text"])


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The documents that pass, with their own columns."""
    turns = order_rules(pick(documents, text="text"), BASE_RULES + rules, sample_rows)
    rows = carry(documents, text="text").withColumn("text", F.coalesce("text", F.lit("")))
    judged = cascade(rows, turns, "failed").select("_source", "failed")
    return behind_barrier(judged, keep=["_source"]).filter("failed IS NULL").select(*put_back(documents.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
hot AS (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT t.doc_id, unnest([t.i, t.i + 1, t.i + 2]) AS p FROM tri t JOIN hot h ON t.doc_id = h.doc_id AND t.g = h.g) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_symbols <= n_words
         AND 2 * n_dup_lines <= n_lines AND n_upper * 10 <= word_chars * 3 AND n_lettered * 10 >= n_words * 8 AS kept
FROM s
"""
