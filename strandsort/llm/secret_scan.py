"""Secret scan: candidates by pattern, false positives removed by a random forest, in DataFrame and ML functions only.

Candidates are values to which a credential name is assigned, whatever their length and characters, and runs of key
characters of 12 or more that have a digit or mixed case or are very long. Features of each: its length, its shares of
digits, upper case and letters, the mean log probability of its character transitions under the corpus's own words, the
share of it that dictionary words cover, whether its parts look like a path, and its neighbours: how many of the words
before and behind it (up to the next candidate) there are and how many the dictionary has.

The forest (Spark ML) is trained on labelled findings. Where none are given, weak labels come from what the features do
not see: a value to which a credential name is assigned is a finding, unless it is a valid card number; a candidate that
stands in running text, neither assigned nor quoted, is a false positive; others have no label. The name, the sign and
the quotes are then no features, so that the forest has to tell from the value and its surroundings, and differs from
the labels where these are wrong or missing. Given findings carry labels of their own, and those three are features too.

Each candidate is scored by a forest that was fitted without it: there are two, each on half of the candidates' values.
Each fit takes ``fit_rows`` labelled findings at most (a documented bound); transitions and dictionary come from all
words of all documents, aggregated by word before any shuffle.

Edge cases: a null or empty text has no candidates. Texts are read whole. Repeated rows are scanned each, and equal values
fall into the same half. With an empty table, or labels of one kind only, nothing is trained: then a candidate is a
secret if a credential name is assigned it. Only ids and texts are read. A run of any length is one candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandsort.llm.common import behind_barrier, cut, pick, table
from strandsort.llm.pii import digits, luhn

CREDENTIAL = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
VALUE = r"(?:\"[^\"\n]++\"|'[^'\n]++'|[^\s\"',;]++)"
#: Where a word begins that has a sign behind it: looked at once a word, so that no word is scanned from each name in it.
SIGNED = r"(?<![\w.-])(?=[\w.-]++[ \t]*+[=:]"
#: A name and the sign behind it; then what it is assigned, quoted or up to a blank.
NAME = rf"[\w.-]*?(?i:{CREDENTIAL})[\w.-]*+[ \t]*+[=:][ \t]*+"
NAMED = rf"{SIGNED}[ \t]*+{VALUE}){NAME}"
#: What any text with a named value has; far cheaper to look for.
TRACE = rf"{SIGNED})[\w.-]*?(?i:{CREDENTIAL})"
#: A run; possessive, and only from where a run begins, so that none is scanned twice. Most words are too short at once.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{12})(?:(?=[A-Za-z+/_=-]*+[0-9])|(?=[A-Za-z0-9+/_=-]*?[a-z][A-Z])|(?=[A-Za-z0-9+/_=-]{20}))[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{11,}+"
CANDIDATE = f"{NAMED}{VALUE}|{RUN}"

CONTENT = ("length", "digits", "upper", "letters", "distinct", "transition", "coverage", "path", "before", "known_before", "after", "known_after")
CONTEXT = ("assigned", "quoted", "credential")


@dataclass(frozen=True)
class Settings:
    #: Words looked at on each side.
    neighbours: int = 3
    fit_rows: int = 20_000
    trees: int = 20
    depth: int = 6
    #: A word is in the dictionary if it stands so often in the corpus.
    min_word_count: int = 20
    seed: int = 3


def surroundings(before: Column, after: Column, settings: Settings) -> dict[str, Column]:
    """What is kept of the texts beside a candidate: the next words, without credential names, and how the text before ends."""
    words = lambda t: F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: (w != "") & ~w.rlike(f"^{CREDENTIAL}$"))
    return {
        "words_before": F.slice(F.reverse(words(before)), 1, settings.neighbours),
        "words_after": F.slice(words(after), 1, settings.neighbours),
        "assigned": before.rlike(r"[=:]\s*+[\"']?+$"),
        "quoted": F.right(before, F.lit(1)).isin('"', "'"),
        # the word at the end, whole, has a name in it
        "credential": F.regexp_extract(before, r"(?<![\w.-])([\w.-]++)\s*+[=:]?+\s*+[\"']?+$", 1).rlike(f"(?i){CREDENTIAL}"),
    }


def candidates(documents: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, start, end, candidate and its surroundings): places in code points.

    The matches of a text and what lies between them are made once, a row a match from then on; what follows looks at a
    match and its two neighbouring pieces only. Places are running sums of lengths over a text's matches.
    """
    c = F.col
    # names are looked for only in texts that have some; the traces are columns behind a barrier, as each is used twice
    sign = F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))
    df = behind_barrier(documents.select("doc_id", "text", F.when(sign, c("text").rlike(TRACE)).otherwise(False).alias("has_name"), c("text").rlike(RUN).alias("has_run")), ["doc_id", "text"]).filter("has_name OR has_run")
    by = lambda f: F.when(c("has_name"), f(CANDIDATE)).otherwise(f(RUN))
    hits, gaps = by(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))), by(lambda p: F.split("text", p, -1))
    df = behind_barrier(df.select("doc_id", F.monotonically_increasing_id().alias("row"), hits.alias("hits"), gaps.alias("gaps")), ["doc_id", "row"])
    pieces = F.transform("hits", lambda h, i: F.struct(h.alias("h"), F.get("gaps", i).alias("before"), F.get("gaps", i + 1).alias("after")))
    df = df.select("doc_id", "row", F.posexplode(pieces).alias("i", "p")).select("doc_id", "row", "i", "p.*")
    # of a named hit, what stands before the value, and the value without its quotes
    lead = F.length(F.regexp_extract("h", f"^{SIGNED})({NAME}[\"']?)", 1))
    df = behind_barrier(df.withColumn("lead", lead), ["doc_id", "row", "i", "h", "before", "after"])
    value = F.when(c("lead") > 0, F.regexp_replace(F.substring("h", c("lead") + 1, F.length("h")), r"^(.*[^\"'])[\"']$", "$1")).otherwise(c("h"))
    beside = surroundings(F.concat("before", F.substring("h", F.lit(1), c("lead"))), c("after"), settings)
    one = df.select("doc_id", "row", "i", "lead", (F.length("before") + F.length("h")).alias("step"), F.length("h").alias("size"), value.alias("candidate"), *[x.alias(k) for k, x in beside.items()])
    so_far = F.sum("step").over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))  # a row a match, without its text
    placed = one.withColumn("start", (so_far - c("size") + c("lead")).cast("int"))
    found = placed.select("doc_id", "start", (c("start") + F.length("candidate")).alias("end"), "candidate", "words_before", "words_after", "assigned", "quoted", "credential")
    return found.filter("candidate <> ''")


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all documents: lower-cased runs of letters."""
    words = documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def transitions(counts: DataFrame) -> DataFrame:
    """(pair, log_p): log probability of the second of two characters after the first, in ASCII words of the corpus."""
    ascii_ = counts.filter(F.col("word").rlike("^[a-z]{2,}$"))
    pairs = ascii_.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    both = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    first = both.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("m"))
    return both.join(first, F.substring(F.col("pair"), 1, 1) == F.col("a")).select("pair", F.log((F.col("n") + 1) / (F.col("m") + 27)).alias("log_p"))


def pairs_of(text: Column) -> Column:
    """All two neighbouring characters, from one split: a substring would be looked for from the text's begin each time."""
    each, n = F.split(text, ""), F.length(text) - 1
    return F.zip_with(F.slice(each, F.lit(1), n), F.slice(each, F.lit(2), n), lambda a, b: F.concat(a, b))


def features(found: DataFrame, counts: DataFrame, settings: Settings) -> DataFrame:
    """found (with _key) and the features; what needs the corpus is computed for each distinct candidate or word."""
    c = F.col
    dictionary = counts.filter(c("n") >= settings.min_word_count).select("word")
    share = lambda pattern: F.length(F.regexp_replace("candidate", pattern, "")) / F.length("candidate")
    # pairs and parts carry a number, as a candidate of any length would otherwise be copied for each of its characters
    distinct = cut(found.select("candidate").distinct().withColumn("_c", F.monotonically_increasing_id()))
    low = F.lower("candidate")
    pair_of = distinct.filter("length(candidate) > 1").select("_c", F.explode(pairs_of(low)).alias("pair")).groupBy("_c", "pair").agg(F.count(F.lit(1)).alias("times"))
    # at most 26 * 26 pairs of letters
    flow = pair_of.join(F.broadcast(transitions(counts)), "pair", "left").groupBy("_c").agg((F.sum(c("times") * F.coalesce("log_p", F.lit(-8.0))) / F.sum("times")).alias("transition"))
    parts = distinct.select("_c", F.explode(F.split(low, "[^a-z]+")).alias("word")).filter(F.length("word") > 2)
    cover = parts.join(dictionary, "word", "left_semi").groupBy("_c").agg(F.sum(F.length("word")).alias("_covered"))
    told = distinct.join(flow, "_c", "left").join(cover, "_c", "left").drop("_c")
    beside = found.select("_key", F.lit("b").alias("side"), F.explode("words_before").alias("word")).union(found.select("_key", F.lit("a").alias("side"), F.explode("words_after").alias("word")))
    known = beside.join(dictionary, "word", "left_semi").groupBy("_key").agg(F.count_if(c("side") == "b").alias("_b"), F.count_if(c("side") == "a").alias("_a"))
    df = found.join(told, "candidate", "left").join(known, "_key", "left")
    return df.withColumns(
        {
            "length": F.least(F.length("candidate"), F.lit(512)).cast("double"),
            "digits": share("[^0-9]"),
            "upper": share("[^A-Z]"),
            "letters": share("[^A-Za-z]"),
            "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
            "transition": F.coalesce("transition", F.lit(-8.0)),
            "coverage": F.coalesce(c("_covered") / F.length("candidate"), F.lit(0.0)),
            "path": share("[^/]") * F.when(c("candidate").rlike(r"^[\w.-]*(?:/[\w.-]+)+$"), 1).otherwise(-1),
            "before": F.size("words_before").cast("double"),
            "after": F.size("words_after").cast("double"),
            "known_before": F.coalesce("_b", F.lit(0)).cast("double"),
            "known_after": F.coalesce("_a", F.lit(0)).cast("double"),
            **{x: c(x).cast("double") for x in CONTEXT},
        }
    ).drop("_covered", "_b", "_a", "words_before", "words_after")


def named(assigned: Column, credential: Column) -> Column:
    return (assigned == 1) & (credential == 1)


def weak_label() -> Column:
    """1, 0 or null, from the context and from what a value is known to be."""
    number = digits(F.substring("candidate", 1, 19))  # no card has more, and the sum looks at the length for each figure
    card = F.col("candidate").rlike("^[0-9]{13,19}$") & luhn(number)
    told = named(F.col("assigned"), F.col("credential"))
    return F.when(told & ~card, 1.0).when(card | ((F.col("assigned") == 0) & (F.col("quoted") == 0)), 0.0)


def half(candidate: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), candidate), F.lit(2))


def fitted(told: DataFrame, names: tuple[str, ...], settings: Settings):
    """A forest from rows with features and label, about half of each kind; None if all labels are alike."""
    by = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    if len(by) < 2:
        return None
    rate = F.when(F.col("label") == 1, min(1.0, settings.fit_rows / 2 / by[1.0])).otherwise(min(1.0, settings.fit_rows / 2 / by[0.0]))
    draw = F.pmod(F.xxhash64("candidate", "_key"), F.lit(1 << 30)) / float(1 << 30)
    rows = VectorAssembler(inputCols=list(names), outputCol="features").transform(told.filter(draw < rate))
    sample = cut(rows.select("features", "label", "_key").repartition(8, F.xxhash64("_key")).select("features", "label"))
    return RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, labelCol="label").fit(sample)


def scan(documents: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, start, end, candidate, named (a credential name is assigned it), score and secret for each candidate.

    findings: before, candidate, after (optional), label (0 or 1).
    """
    c = F.col
    docs = pick(documents, doc_id=id_col, text=text_col)
    found = cut(candidates(docs, settings).withColumn("_key", F.monotonically_increasing_id()))
    counts = cut(word_counts(docs))
    rows = cut(features(found, counts, settings))
    if findings is None:
        names, told = CONTENT, rows.withColumn("label", weak_label()).filter("label IS NOT NULL")
    else:
        after = c("after") if "after" in findings.columns else F.lit("")
        given = findings.select("candidate", c("label").cast("double").alias("label"), *[x.alias(k) for k, x in surroundings(c("before"), after, settings).items()])
        names, told = CONTENT + CONTEXT, features(cut(given.withColumn("_key", F.monotonically_increasing_id())), counts, settings)
    out, plain = None, named(c("assigned"), c("credential")).cast("double")
    for k in range(2):
        model = fitted(told.filter(half(c("candidate")) == 1 - k), names, settings)
        mine = rows.filter(half(c("candidate")) == k)
        if model is None:
            scored = mine.withColumn("score", plain)
        else:
            scored = model.transform(VectorAssembler(inputCols=list(names), outputCol="features").transform(mine)).withColumn("score", vector_to_array(c("probability"))[1])
        scored = scored.select("doc_id", "start", "end", "candidate", named(c("assigned"), c("credential")).alias("named"), "score", (c("score") > 0.5).alias("secret"))
        out = scored if out is None else out.unionByName(scored)
    return out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "named", F.round("score", 6).alias("score"), "secret")
