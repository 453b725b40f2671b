"""URL filter: host and path rules, and association rules mined by FP-growth from labelled pages.

A URL is a set of tokens (the host, its last one to three labels, path segments with digits folded, extension, query keys,
fragment). FP-growth finds token sets that are frequent among pages labelled bad. A set is a rule if, over all labelled
pages, its confidence (share of bad pages among those that have it) is ``min_lift`` times the share of bad pages in all,
that is more than chance would give (a one-sided binomial test at ``alpha``, shared out among all sets tried), and no
subset of it is a rule of the same confidence or more. So thresholds follow the labels' base rate and number, and labels
that have nothing to do with URLs give no rule. Tokens that stand on exactly the same labelled pages say the same: they
are one token to the mining, whose sets and number of tests would otherwise double with each of them, and each of them
matches its rules. Tokens on all labelled pages say nothing and take no part. Each rule is filed under its rarest token; a page looks up its tokens and
checks the sets found there, so that common tokens lead to few look-ups.

A host implies its own endings, so that sets of several of them say nothing new. FP-growth is therefore given each bad page
once for each ending, with that one alone beside the other tokens, and once without any.

Host rules (``net/``, ``example.net/en/``): a rule fits its host and all subdomains if the path starts with the rule's;
the longest wins. What no host rule decides is blocked if an association rule matches, else allowed.

Edge cases: a null URL or one without ``://`` has empty host and path and no tokens, and is allowed. A page is labelled
if its id has a label; of repeated labels the worst counts. Without bad labels there are no association rules. Repeated
rows are judged row by row, and count as often as they stand there; an empty table gives an empty result. URLs are read
whole, however long. Only id and url are read of the pages, so that no column can clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandsort.llm.common import cut, pick, table


@dataclass(frozen=True)
class HostRule:
    action: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


HOST_RULES = (HostRule("block", "net/"), HostRule("allow", "example.net/en/"), HostRule("block", "example.com/de/"), HostRule("allow", "org/fr/"))


@dataclass(frozen=True)
class Mining:
    #: A set must occur in this share of the bad pages, and so many of them, at least.
    min_support: float = 0.005
    min_bad: int = 5
    min_lift: float = 1.5
    alpha: float = 0.01
    #: Up to so many rules are broadcast; more are joined by a shuffle.
    broadcast_rules: int = 100_000


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased), path and _rest (query and fragment)."""
    after = F.substring_index(F.coalesce(F.col(f"`{url}`"), F.lit("")), "://", 1)
    has = F.contains(F.coalesce(F.col(f"`{url}`"), F.lit("")), F.lit("://"))
    tail = F.when(has, F.substring(F.col(f"`{url}`"), F.length(after) + 4, F.length(F.col(f"`{url}`")))).otherwise("")
    df = pages.withColumn("_tail", tail)
    df = df.withColumn("host", F.translate(F.regexp_extract("_tail", "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    df = df.withColumn("_path_on", F.regexp_replace("_tail", "^[^/?#]*", ""))
    df = df.withColumn("path", F.regexp_extract("_path_on", "(?s)^[^?#]*", 0))
    return df.withColumn("_rest", F.substring("_path_on", F.length("path") + 1, F.length("_path_on"))).drop("_tail", "_path_on")


def host_rule(rules: tuple[HostRule, ...]) -> tuple[Column, Column]:
    """The rule that decides and its action; null where none fits."""
    host, path = F.col("host"), F.col("path")
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    ordered = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    by = F.coalesce(*[F.when(fits(r), F.lit(r.rule)) for r in ordered]) if ordered else F.lit(None).cast("string")
    action = F.coalesce(*[F.when(fits(r), F.lit(r.action)) for r in ordered]) if ordered else F.lit(None).cast("string")
    return by, action


def named(kind: str, items: Column) -> Column:
    return F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))


def endings() -> Column:
    """The host and its last one, two and three labels, as far as they differ."""
    return F.array_distinct(named("host", F.array("host", *[F.substring_index("host", ".", -k) for k in (1, 2, 3)])))


def other_tokens() -> Column:
    """The distinct tokens of a page with path and _rest."""
    segments = F.transform(F.split(F.lower("path"), "/"), lambda s: F.regexp_replace(F.regexp_replace(s, r"\.[a-z0-9]{1,5}$", ""), "[0-9]+", "0"))
    keys = F.transform(F.split(F.regexp_extract("_rest", r"^\?([^#]*)", 1), "&"), lambda p: F.substring_index(p, "=", 1))
    all_ = F.concat(
        named("path", segments),
        named("ext", F.array(F.regexp_extract(F.lower("path"), r"\.([a-z0-9]{1,5})$", 1))),
        named("query", keys),
        named("fragment", F.array(F.regexp_extract("_rest", "#(.*)$", 1))),
    )
    return F.array_distinct(all_)


def matches(sets: DataFrame, rules: DataFrame, mining: Mining) -> DataFrame:
    """The columns of sets (with tokens) and rule_id, for each rule (rule_id, items, key) that a row contains."""
    filed = rules.select("rule_id", "items", F.col("key").alias("token"))
    if filed.count() <= mining.broadcast_rules:
        filed = F.broadcast(filed)
    looked = sets.withColumn("token", F.explode("tokens")).join(filed, "token")
    return looked.filter(F.size(F.array_except("items", "tokens")) == 0).drop("token", "items")


def beyond_chance(bad: Column, n: Column, base: float, alpha: float) -> Column:
    """Whether so many bad ones of n have a lower chance than alpha where each is bad with the chance ``base`` (Chernoff's bound)."""
    share = bad / n
    divergence = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return (share > base) & (n * divergence > -math.log(alpha))


def frequent_sets(labelled: DataFrame, bad_pages: int, mining: Mining) -> DataFrame:
    """(rule_id, items) of the candidates: sets that are frequent among bad pages, with one ending of the host at most."""
    spark = labelled.sparkSession
    bad = labelled.filter("bad").select("ends", "others")
    with_one = F.transform("ends", lambda e: F.concat(F.array(e), "others"))
    views = cut(bad.select(F.explode(F.concat(with_one, F.array("others"))).alias("items")))
    least = max(mining.min_bad, mining.min_support * bad_pages)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(minSupport=least / views.count(), minConfidence=1.0, itemsCol="items", numPartitions=parts).fit(views)
    found = model.freqItemsets.select(F.array_sort("items").alias("items"))
    return cut(found.withColumn("rule_id", F.xxhash64(F.array_join("items", "\n"))))


def merged_tokens(labelled: DataFrame, total: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (ends, others, tokens, bad) with one token for all that stand on the same pages, without those on every page; and (token, one).

    Pages are told by an order-free digest of 128 bits. Tokens that are too rare among bad pages for any set are left as they are.
    """
    c = F.col
    rows = cut(labelled.withColumn("_p", F.monotonically_increasing_id()))
    each = rows.select("_p", "bad", F.explode("others").alias("token"))
    where = [F.bit_xor(F.xxhash64(F.lit(k), "_p")).alias(f"_x{k}") for k in range(2)]
    told = each.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.count_if("bad").alias("_bad"), *where).filter(c("_bad") >= least)
    known = cut(told.select("token", "_n", F.min("token").over(Window.partitionBy("_n", "_x0", "_x1")).alias("one")))
    same = known.filter("token <> one").select("token", "one")
    fewer = each.join(known, "token", "left").filter(F.coalesce(c("_n") < total, F.lit(True)))
    kept = fewer.groupBy("_p").agg(F.collect_set(F.coalesce("one", "token")).alias("_others"))  # a page's own tokens
    out = rows.join(kept, "_p", "left").withColumn("others", F.coalesce("_others", F.array().cast("array<string>")))
    return cut(out.select("ends", "others", F.concat("ends", "others").alias("tokens"), "bad")), same


def with_merged(sets: DataFrame, same: DataFrame, mining: Mining) -> DataFrame:
    """Rows (id, tokens) with the tokens that stand for some of theirs beside them."""
    n = same.count()
    if not n:
        return sets
    stand = sets.select("id", F.explode("tokens").alias("token")).join(F.broadcast(same) if n <= mining.broadcast_rules else same, "token")
    more = stand.groupBy("id").agg(F.collect_set("one").alias("_more"))
    return sets.join(more, "id", "left").withColumn("tokens", F.when(F.col("_more").isNull(), F.col("tokens")).otherwise(F.array_union("tokens", "_more"))).drop("_more")


def mine(labelled: DataFrame, mining: Mining) -> tuple[DataFrame, DataFrame]:
    """(rule_id, items, key, support, confidence) from rows (ends, others, tokens, bad); and (token, one), the token of the rules that stands for a token."""
    c = F.col
    spark = labelled.sparkSession
    no_tokens = spark.createDataFrame([], "token string, one string")
    none = spark.createDataFrame([], "rule_id long, items array<string>, key string, support long, confidence double")
    total, bad_pages = labelled.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if not bad_pages or bad_pages == total:
        return none, no_tokens
    labelled, same = merged_tokens(labelled, total, max(mining.min_bad, mining.min_support * bad_pages))
    often = frequent_sets(labelled, bad_pages, mining)
    tried = often.count()
    if not tried:
        return none, no_tokens
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = often.select("rule_id", F.explode("items").alias("token")).join(counts, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("m"))
    keyed = often.join(rarest.select("rule_id", c("m.token").alias("key")), "rule_id")
    held = matches(labelled.select("tokens", "bad"), keyed, mining).groupBy("rule_id").agg(F.count(F.lit(1)).alias("support"), F.count_if("bad").alias("n_bad"))
    scored = keyed.join(held, "rule_id").withColumn("confidence", c("n_bad") / c("support"))
    base = bad_pages / total
    enough = c("n_bad") >= max(mining.min_bad, mining.min_support * bad_pages)
    good = cut(scored.filter(enough & (c("confidence") >= mining.min_lift * base) & beyond_chance(c("n_bad"), c("support"), base, mining.alpha / tried)))
    # a rule falls if a smaller one that it contains is as sure: such a one is found under its key among the rule's items
    small = good.select(c("rule_id").alias("other"), c("items").alias("part"), c("confidence").alias("sure"), c("key").alias("token"))
    covered = good.select("rule_id", "items", "confidence", F.explode("items").alias("token")).join(small, "token")
    covered = covered.filter((F.size("part") < F.size("items")) & (c("sure") >= c("confidence")) & (F.size(F.array_except("part", "items")) == 0))
    return good.join(covered.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "items", "key", "support", "confidence"), same


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[HostRule, ...] = HOST_RULES, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict and n_rules (association rules that match), a row for each page."""
    docs = with_parts(pick(pages, page_id="page_id", url="url")).select("page_id", "host", "path", endings().alias("ends"), other_tokens().alias("others"))
    docs = cut(docs.withColumns({"tokens": F.concat("ends", "others"), "id": F.monotonically_increasing_id()}))
    told = pick(labels, page_id="doc_id", quality="quality", toxic="toxic").groupBy("page_id").agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    mined, same = mine(cut(docs.join(told, "page_id").select("ends", "others", "tokens", "bad")), mining)
    mined, same = cut(mined), cut(same)
    hit = matches(with_merged(docs.select("id", "tokens"), same, mining), mined, mining).groupBy("id").agg(F.count(F.lit(1)).alias("n_rules"))
    by, action = host_rule(rules)
    judged = docs.join(hit, "id", "left").withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
    verdict = F.coalesce(action, F.when(F.col("n_rules") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", by.alias("rule"), verdict.alias("verdict"), "n_rules")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
