"""Personal data: base patterns, and terms that reveal protected values, in DataFrame functions only.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns. The patterns are put so
that no group repeats without bound and no run is scanned again from each of its characters: separators inside a match
are first replaced by one private character, and a match starts at a run's first character or where the last one ended.

Information-theoretic sanitisation. The protected entities are the base values, and what values share: the domain of an
address, the first three parts of an ip, the first six digits of a card, the first four of a phone number. For a term in
the words beside one, the corpus tells how much of the entity's information it discloses:

    disclosure(t, e) = PMI(t; e) / IC(e) = log(n(t, e) * N / (n(t) * n(e))) / log(N / n(e))

with N documents, n(e) those that hold the entity, n(t) those that hold the term anywhere and n(t, e) those in which the
term stands beside it: among the next ``window`` words on either side, up to the next value. 1 means that the term gives
the entity away. Evidence is needed from ``support`` different texts: copies of a whole text count once, a signature in
different texts as often as it stands there. A value that is too rare for that is judged by what it shares. At
``generalise`` a term is replaced by its class in the sanitised text, at ``remove`` it is taken out; either adds a span
of kind term, in every document that holds the entity.

All counts cover the whole corpus. Only documents with base spans take part in the pair counts, which are combined before
the shuffle, and only the terms that are left are counted in all documents.

Edge cases: a null text is empty and has no spans (its text stays null when sanitised). Repeated rows are counted and
judged row by row. An empty table gives an empty result. Only ids and texts are read. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.llm.common import carry, cut, put_back, table

#: A private-use character; where a text has it itself, it reads as a letter there, which no pattern takes as a mark.
MARK = ""
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, as rewritten; MARK stands for a separator between two characters that may be separated.
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{MARK}-])|\G)[A-Za-z0-9._%+{MARK}-]+@[A-Za-z0-9-]+{MARK}[A-Za-z0-9{MARK}-]*[A-Za-z0-9-]"
IP = r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = rf"[0-9][0-9{MARK}]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


@dataclass(frozen=True)
class Policy:
    window: int = 8
    support: int = 3
    generalise: float = 0.8
    remove: float = 0.95
    #: Up to so many terms are broadcast; more are joined by a shuffle.
    broadcast_terms: int = 200_000


def found(text: Column, pattern: str, kind: str) -> Column:
    """All matches of the pattern as (kind, start, end, value), by the lengths of what lies between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.aggregate(
        pairs,
        empty,
        lambda acc, p: F.concat(
            acc,
            F.array(
                F.struct(
                    F.lit(kind).alias("kind"),
                    (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + p["g"]).alias("start"),
                    (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + p["g"] + F.length(p["h"])).alias("end"),
                    p["h"].alias("value"),
                )
            ),
        ),
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """A digit string's check sum is a multiple of ten."""
    n = F.length(number)
    doubled = lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    figures = F.transform(F.split(number, ""), lambda d: d.try_cast("int"))
    return F.aggregate(F.transform(F.filter(figures, lambda d: d.isNotNull()), doubled), F.lit(0), lambda a, d: a + d) % 10 == 0


def small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def with_base(documents: DataFrame) -> DataFrame:
    """Add _<kind> for each kind: arrays of (kind, start, end, value), the value without separators. Texts without a trace of a kind skip its patterns."""
    c = F.col
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    df = documents.withColumn("_t", F.coalesce(c("_text"), F.lit("")))
    traces = {"email": F.contains(c("_t"), F.lit("@")), "ip": c("_t").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": c("_t").rlike(r"[0-9](?:[ -]?[0-9]){12}"), "phone": c("_t").rlike(r"\+[0-9]")}
    df = df.withColumns({f"_has_{k}": v for k, v in traces.items()})
    marked = lambda t, a, sep, z: F.regexp_replace(F.translate(t, MARK, "à"), f"(?<={a}){sep}(?={z})", MARK)
    label = "[A-Za-z0-9-]"
    sources = {"email": marked(c("_t"), label, r"\.", label), "ip": c("_t"), "card": marked(c("_t"), "[0-9]", "[ -]", "[0-9]"), "phone": c("_t")}
    df = df.withColumns({f"_s_{k}": F.when(c(f"_has_{k}"), v) for k, v in sources.items()})
    df = df.withColumns({f"_{k}": F.when(c(f"_has_{k}"), found(c(f"_s_{k}"), p, k)).otherwise(none) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)})
    size = lambda x: F.length(digits(x["value"]))
    keeps = {
        "ip": lambda x: small_parts(x["value"]),
        "card": lambda x: size(x).between(13, 19) & luhn(digits(x["value"])),
        "phone": lambda x: size(x).between(9, 15),
    }
    df = df.withColumns({f"_{k}": F.filter(f"_{k}", keep) for k, keep in keeps.items()})
    plain = {"email": lambda v: F.lower(F.translate(v, MARK, ".")), "ip": lambda v: v, "card": digits, "phone": lambda v: F.concat(F.lit("+"), digits(v))}
    normal = lambda f: lambda s: s.withField("value", f(s["value"]))
    df = df.withColumns({f"_{k}": F.transform(f"_{k}", normal(f)) for k, f in plain.items()})
    return df.drop("_t", *[f"_has_{k}" for k in KINDS], *[f"_s_{k}" for k in KINDS])


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def entities(kind: str, value: Column) -> Column:
    """The entities that a value stands for: itself and what it shares with others."""
    shared = {"email": F.substring_index(value, "@", -1), "ip": F.substring_index(value, ".", 3), "card": F.substring(value, 1, 6), "phone": F.substring(value, 1, 5)}[kind]
    return F.array(F.concat(F.lit(f"{kind} "), value), F.concat(F.lit(f"{kind} of "), shared))


def held_entities() -> Column:
    """The entities of a row with base spans, each once."""
    of = lambda kind: F.transform(f"_{kind}", lambda s: entities(kind, s["value"]))
    return F.array_distinct(F.flatten(F.concat(*map(of, KINDS))))


def beside(policy: Policy) -> tuple[Column, Column]:
    """_spans, and the distinct (entity, term) of a row that has them: lower-cased words between a value and the next one, ``window`` at most."""
    of = lambda kind: F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("z"), entities(kind, s["value"]).alias("of")))
    spans = F.array_sort(F.concat(*map(of, KINDS)))
    words = lambda a, z: F.filter(F.split(F.lower(F.substring("_text", a + 1, F.greatest(z - a, F.lit(0)))), r"[^\p{L}]+"), lambda w: w != "")
    last = F.length("_text")
    around = lambda s, i: F.concat(
        F.slice(F.reverse(words(F.coalesce(F.get("_spans", i - 1)["z"], F.lit(0)), s["a"])), 1, policy.window),
        F.slice(words(s["z"], F.coalesce(F.get("_spans", i + 1)["a"], last)), 1, policy.window),
    )
    pairs = F.transform("_spans", lambda s, i: F.flatten(F.transform(around(s, i), lambda t: F.transform(s["of"], lambda e: F.struct(e.alias("entity"), t.alias("term"))))))
    return spans, F.array_distinct(F.flatten(pairs))


def disclosing(documents: DataFrame, based: DataFrame, policy: Policy) -> DataFrame:
    """(entity, term, disclosure): terms at or above the lower threshold, from counts over all documents."""
    c = F.col
    n_entity = based.select(F.explode(held_entities()).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    spans, pairs = beside(policy)
    each = based.withColumn("_spans", spans).select(F.xxhash64("_text").alias("text"), F.explode(pairs).alias("p")).select("text", "p.*")
    by_text = each.groupBy("entity", "term", "text").agg(F.count(F.lit(1)).alias("n"))
    counted = by_text.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("support")).filter(c("support") >= policy.support)
    counted = cut(counted.join(n_entity, "entity"))
    terms = cut(counted.select("term").distinct())
    n_terms = terms.count()
    if not n_terms:
        return counted.select("entity", "term", F.lit(0.0).alias("disclosure"))
    if n_terms <= policy.broadcast_terms:
        terms = F.broadcast(terms)
    words = documents.select(F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))).alias("term"))
    held = words.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = float(documents.count())
    scored = counted.join(held, "term").withColumn("disclosure", F.try_divide(F.log(c("n_te") * total / (c("n_t") * c("n_e"))), F.log(F.lit(total) / c("n_e"))))
    return scored.filter(c("disclosure") >= policy.generalise).select("entity", "term", "disclosure")


NO_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def term_spans(based: DataFrame, terms: DataFrame, policy: Policy) -> DataFrame:
    """Add _term and _removed (of the same kind): where disclosing terms of a document's entities stand in it."""
    c = F.col
    values = based.select("_row", F.explode(held_entities()).alias("entity"))
    strong = F.collect_set(F.when(c("disclosure") >= policy.remove, c("term")))
    held = values.join(terms, "entity").groupBy("_row").agg(F.array_sort(F.collect_set("term")).alias("_all"), strong.alias("_strong"))
    df = based.join(held, "_row", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_all", "|"), F.lit(r")(?!\p{L})"))
    df = df.withColumn("_found", F.when(c("_all").isNotNull(), found(c("_text"), pattern, "term")).otherwise(F.array().cast(NO_SPANS)))
    gone = lambda s: F.coalesce(F.array_contains("_strong", F.lower(s["value"])), F.lit(False))
    return df.withColumns({"_term": F.filter("_found", lambda s: ~gone(s)), "_removed": F.filter("_found", gone)}).drop("_strong", "_all", "_found", "_row")


def replaced(text: Column, spans: Column, removed: Column) -> Column:
    """The text with [KIND] for each span and nothing for removed ones; of overlapping spans the first counts."""
    marks = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    gone = F.transform(removed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("by")))
    done = F.aggregate(
        F.array_sort(F.concat(marks, gone)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"])).alias("out"))
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) + F.size(removed) > 0, done).otherwise(text)


def sanitise(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = Policy()) -> DataFrame:
    """_source (the input row, see carry()), doc_id, sanitised, n_<kind>, base_spans and spans (arrays of kind, start, end, value), a row per document."""
    c = F.col
    docs = carry(documents, _id=id_col, _text=text_col)
    # the filters would be pushed below the patterns, which would then be searched once more; not past this id
    judged = with_base(docs).withColumn("_row", F.monotonically_increasing_id())
    some = "_row >= 0 AND (" + " OR ".join(f"size(_{k}) > 0" for k in KINDS) + ")"
    based = cut(judged.filter(some))
    terms = cut(disclosing(docs, based, policy))
    none = F.array().cast(NO_SPANS)
    rest = judged.filter(f"NOT ({some})").drop("_row").withColumns({"_term": none, "_removed": none})
    df = term_spans(based, terms, policy).unionByName(rest)
    base = F.concat(*[f"_{k}" for k in KINDS])
    return df.select(
        "_source",
        c("_id").alias("doc_id"),
        replaced(c("_text"), F.concat(base, "_term"), c("_removed")).alias("sanitised"),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        base.alias("base_spans"),
        F.concat(base, F.array_sort(F.concat("_term", "_removed"), lambda a, b: a["start"] - b["start"])).alias("spans"),
    )


def sanitised_documents(documents: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The documents with their sanitised texts, and n_chars, if there is such a column, as it then is."""
    found_ = sanitise(documents, policy=policy)
    return found_.select(*put_back(documents.columns, {"text": F.col("sanitised"), "n_chars": F.length("sanitised").cast("long")}))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_ = sanitise(table(spark, sf_dir, "documents"))
    return found_.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
