"""Counts and reports over assigned templates: ordinary aggregations, combined before the shuffle.

``assigned`` has sample_ordinal (never null), matched (whether a barcode matched), hamming_dist, bc, bc_delim and the
quality counts of the template and barcode segments: a row a template, or one for each barcode with n_reads, how many
templates it stands for. The groups are samples, a sheet's worth, so that a third of all
reads in one of them adds nothing to a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandsort.samples import Sample

COUNTS = ("total_matches", "perfect_matches", "one_mismatch_matches", "q20_bases", "q30_bases", "total_number_of_bases", "index_quality_sum", "index_bases")
REPORT = ("sample_ID", "barcode", "total_matches", "perfect_matches", "one_mismatch_matches", "q20_bases", "q30_bases", "total_number_of_bases", "fraction_matches", "ratio_this_barcode_to_best_barcode", "frac_q20_bases", "frac_q30_bases", "mean_index_base_quality")
QUALITY = ("q20_bases", "q30_bases", "total_number_of_bases", "index_quality_sum", "index_bases")


def sample_table(spark, samples: list[Sample]) -> DataFrame:
    rows = [(s.ordinal, s.sample_id, s.semantic_barcode, s.project, i == len(samples) - 1) for i, s in enumerate(samples)]
    return spark.createDataFrame(rows, "ordinal int, sample_id string, barcode string, project string, is_last boolean")


def counted(rows: DataFrame, condition: Column | None = None) -> Column:
    """How many templates the rows of a group that meet the condition stand for."""
    n = F.col("n_reads") if "n_reads" in rows.columns else F.lit(1)
    return F.coalesce(F.sum(n if condition is None else F.when(condition, n)), F.lit(0)).cast("long")


def per_sample_counts(assigned: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    quality = [F.sum(F.col(q) if q in assigned.columns else none).cast("long").alias(q) for q in QUALITY]
    return assigned.groupBy(F.col("sample_ordinal").alias("ordinal")).agg(
        counted(assigned).alias("total_matches"),
        *[counted(assigned, F.col("matched") & (F.col("hamming_dist") == d)).alias(name) for d, name in enumerate(("perfect_matches", "one_mismatch_matches"))],
        *quality,
    )


def with_all_samples(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each sample, also those without reads."""
    return samples.join(counts, "ordinal", "left").fillna(0, list(COUNTS))


def per_project_counts(per_sample: DataFrame, barcode_length: int) -> DataFrame:
    """Sums by project, the last (undetermined) sample for itself at the end. Ordinals give the order of the report."""
    named = per_sample.filter("NOT is_last").groupBy("project").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])
    named = named.select(
        F.struct(F.lit(0).alias("a"), F.col("project").isNotNull().alias("b"), F.col("project").alias("c")).alias("_order"),
        F.coalesce("project", F.lit("None")).alias("sample_id"),
        F.lit("N" * barcode_length).alias("barcode"),
        *COUNTS,
        F.lit(False).alias("is_last"),
    )
    last = per_sample.filter("is_last").select(F.struct(F.lit(1).alias("a"), F.lit(True).alias("b"), F.lit(None).cast("string").alias("c")).alias("_order"), "sample_id", "barcode", *COUNTS, "is_last")
    return named.unionByName(last)


def ratio(a: Column, b: Column) -> Column:
    """IEEE division: 0 / 0 is NaN, n / 0 infinite."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))


def report(groups: DataFrame) -> DataFrame:
    """The columns of a per-group report. Totals are over all groups, the best group is one but the last."""
    c = F.col
    whole = Window.partitionBy(F.lit(0))  # one row a sample or project: the reads are summed up by now
    best = F.coalesce(F.max(F.when(~c("is_last"), c("total_matches"))).over(whole), F.lit(0))
    joined = groups.withColumns({"_total": F.sum("total_matches").over(whole), "_best": best})
    return joined.select(
        *[x for x in ("ordinal", "_order") if x in groups.columns],
        c("sample_id").alias("sample_ID"),
        *REPORT[1:8],
        ratio(c("total_matches"), c("_total")).alias("fraction_matches"),
        ratio(c("total_matches"), c("_best")).alias("ratio_this_barcode_to_best_barcode"),
        ratio(c("q20_bases"), c("total_number_of_bases")).alias("frac_q20_bases"),
        ratio(c("q30_bases"), c("total_number_of_bases")).alias("frac_q30_bases"),
        ratio(c("index_quality_sum"), c("index_bases")).alias("mean_index_base_quality"),
    )


def run_counts(reads: DataFrame) -> DataFrame:
    """One row from drop_reason (control, quality or null for templates that stay)."""
    return reads.agg(
        counted(reads, F.col("drop_reason") == "control").alias("control_reads_omitted"),
        counted(reads, F.col("drop_reason") == "quality").alias("failing_reads_omitted"),
        counted(reads, F.col("drop_reason").isNull()).alias("total_templates"),
    )


def unmatched_counts(assigned: DataFrame) -> DataFrame:
    """Exact counts of the delimited barcodes of templates without a match."""
    return assigned.filter("NOT matched").groupBy(F.col("bc_delim").alias("barcode")).agg(counted(assigned).alias("count"))


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "barcode").limit(n)


def is_hop(barcode: Column, length1: int, length2: int, halves: list[tuple[str, str]]) -> Column:
    """Both halves are known, each from some sample, or so they are when read the other way round."""
    first, second = sorted({a for a, _ in halves}), sorted({b for _, b in halves})
    straight = F.substring(barcode, 1, length1).isin(first) & F.substring(barcode, length1 + 1, length2).isin(second)
    turned = F.substring(barcode, length2 + 1, length1).isin(first) & F.substring(barcode, 1, length2).isin(second)
    return (F.length(barcode) == length1 + length2) & (straight | turned)


def hop_counts(assigned: DataFrame, length1: int, length2: int, samples: list[Sample]) -> DataFrame:
    """Counts of unmatched templates whose barcode hopped, as index1+index2."""
    halves = [(s.barcode[:length1], s.barcode[length1:]) for s in samples]
    hopped = assigned.filter("NOT matched").filter(is_hop(F.col("bc"), length1, length2, halves))
    counts = hopped.groupBy("bc").agg(counted(hopped).alias("count"))
    return counts.select(F.concat(F.substring("bc", 1, length1), F.lit("+"), F.substring(F.col("bc"), F.lit(length1 + 1), F.length("bc"))).alias("barcode"), "count")
