"""Queries over the driver's tables for sheets that are tables themselves: as many samples as orders or customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.operators import matching as M
from strandsort.operators import pigeonhole


def key_barcode_sql(key: str, bases: int) -> str:
    """A barcode of at least ten bases for each key: base-4 digits of two products, of which the first differ for all keys below 4**10."""
    digit = lambda v, d: f"substr('ACGT', 1 + CAST(floor(({v}) / {4**d}.0) AS INT) % 4, 1)"
    first, second = f"({key} * 48271 + 11) % 1048576", f"({key} * 69621 + 7) % 1048576"
    return "concat(" + ", ".join([*[digit(first, d) for d in range(10)], *[digit(second, d) for d in range(bases - 10)]]) + ")"


def misread_sql(key: str, other: str, bases: int) -> str:
    """The key's barcode as it was read: none, one or two bases changed, or an N in it, by another column."""
    swap = lambda b, p, by: f"concat(substr({b}, 1, CAST({p} AS INT) - 1), {by}, substr({b}, CAST({p} AS INT) + 1))"
    changed = lambda b, p: swap(b, p, f"translate(substr({b}, CAST({p} AS INT), 1), 'ACGTN', 'CGTAN')")
    exact = key_barcode_sql(key, bases)
    once = f"CASE WHEN {other} % 3 = 0 THEN {changed('b0', f'1 + {other} % {bases}')} ELSE b0 END"
    twice = f"CASE WHEN {other} % 7 = 0 THEN {changed('b1', f'1 + {other} % {bases - 2}')} ELSE b1 END"
    with_n = f"CASE WHEN {other} % 11 = 0 THEN {swap('b2', f'1 + {other} % 5', chr(39) + 'N' + chr(39))} ELSE b2 END"
    return f"SELECT {key} AS read_key, {with_n} AS bc FROM (SELECT *, {twice} AS b2 FROM (SELECT *, {once} AS b1 FROM (SELECT *, {exact} AS b0 FROM {{orders}}) x0) x1) x2"


BASES, READS = 15, misread_sql("o_orderkey", "o_custkey", 15)
SHEET = f"SELECT {key_barcode_sql('o_orderkey', BASES)} AS barcode, CAST(o_orderkey AS INT) AS sample_ordinal FROM {{orders}}"


def match_large_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many samples as orders, each read once with or without faults: one mismatch, a delta of two, one free N."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    reads, sheet = spark.sql(READS, orders=orders), spark.sql(SHEET, orders=orders)
    found = M.with_match(reads, "bc", sheet, M.MatcherKind.CACHED, 1, 2, 1)
    return found.select("read_key", "bc", F.coalesce("sample_ordinal", F.lit(-1)).alias("sample_ordinal"), F.coalesce("hamming_dist", F.lit(-1)).alias("hamming_dist"))


MATCH_LARGE_SHEET = f"""
WITH r AS ({READS.format(orders="orders")}), s AS ({SHEET.format(orders="orders")}), b AS (SELECT DISTINCT bc, least(length(bc) - length(replace(bc, 'N', '')), 1) AS free FROM r),
d AS (SELECT bc, sample_ordinal, hamming(bc, barcode) - free AS dist FROM b CROSS JOIN s WHERE hamming(bc, barcode) <= 4),
k AS (SELECT bc, min(dist) AS best FROM d GROUP BY bc HAVING min(dist) <= 1),
f AS (SELECT k.bc, k.best, min(sample_ordinal) AS sample_ordinal FROM k JOIN d ON k.bc = d.bc AND d.dist - k.best <= 2 GROUP BY k.bc, k.best HAVING count(*) = 1)
SELECT read_key, r.bc, coalesce(f.sample_ordinal, -1) AS sample_ordinal, CAST(coalesce(best, -1) AS INT) AS hamming_dist FROM r LEFT JOIN f ON r.bc = f.bc"""


CUSTOMERS = f"SELECT CAST(c_custkey AS BIGINT) AS sample_ordinal, {key_barcode_sql('c_custkey', 12)} AS barcode FROM {{customer}}"


def sheet_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two customers whose barcodes reads could confuse: three mismatches and a delta of three."""
    sheet = spark.sql(CUSTOMERS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return pigeonhole.first_violation(sheet, 3, 3).select(F.col("first").alias("first_sample"), F.col("second").alias("second_sample"), "distance", "fault")


SHEET_VIOLATION = f"""
WITH s AS ({CUSTOMERS.format(customer="customer")})
SELECT a.sample_ordinal AS first_sample, b.sample_ordinal AS second_sample, CAST(hamming(a.barcode, b.barcode) AS INT) AS distance, CASE WHEN hamming(a.barcode, b.barcode) < 3 THEN 'collision' ELSE 'delta' END AS fault
FROM s a JOIN s b ON a.sample_ordinal < b.sample_ordinal AND hamming(a.barcode, b.barcode) <= 3 ORDER BY 1, 2 LIMIT 1"""


ALL = {
    "match_large_sheet": (match_large_sheet, MATCH_LARGE_SHEET),
    "sheet_violation": (sheet_violation, SHEET_VIOLATION),
}
