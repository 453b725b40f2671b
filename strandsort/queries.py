"""Queries over the driver's tables. Reads are derived from their rows by the same SQL text in Spark and in DuckDB.

Samples come from nation and region (barcodes of base-4 digits, each letter three or five times), reads from orders or
lineitem: the expected barcode of the key's sample with substitutions and Ns, a template and qualities from the row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort import table_queries
from strandsort.functions import header as H
from strandsort.functions import segments as G
from strandsort.operators import matching as M
from strandsort.operators import metrics as R
from strandsort.operators import partial_metrics as P
from strandsort.operators.heavy_hitters import frequent_exact
from strandsort.operators.numbering import shared_folder
from strandsort.plans.demux import Demultiplexer, Rules, zip_reads
from strandsort.read_structure import ReadStructure
from strandsort.samples import Sample
from strandsort.streaming.runs import running_counts

DIGITS = "substr('ACGT', 1 + CAST(floor({k} / 16.0) AS INT) % 4, 1)", "substr('ACGT', 1 + CAST(floor({k} / 4.0) AS INT) % 4, 1)", "substr('ACGT', 1 + CAST({k} % 4 AS INT), 1)"


def barcode_sql(k: str, times: int) -> str:
    return "concat(" + ", ".join(f"repeat({d.format(k=k)}, {times})" for d in DIGITS) + ")"


def reads_sql(source: str, key: str, other: str, filtered: str, control: str, quality: str, times: int, extra: str = "") -> str:
    """Rows of reads: key, head, bc, umi, template, tqual, bqual."""
    n = 3 * times
    swap = lambda b, p, by: f"concat(substr({b}, 1, CAST({p} AS INT) - 1), {by}, substr({b}, CAST({p} AS INT) + 1))"
    changed = lambda b, p: swap(b, p, f"translate(substr({b}, CAST({p} AS INT), 1), 'ACGTN', 'CGTAN')")
    return f"""
    SELECT read_key, other, concat('INS:7:FC1:', CAST(1 + read_key % 8 AS STRING), ':1101:', CAST(read_key AS STRING), ':', CAST(other AS STRING), ' 1:', filtered, ':', control, ':NNNNNNNN') AS head,
           CASE WHEN other % 11 = 0 THEN {swap("b2", "1 + other % 5", "'N'")} ELSE b2 END AS bc,
           substr(translate(lpad(CAST(other AS STRING), 8, '0'), '0123456789', 'ACGTACGTAC'), 1, 6) AS umi,
           concat(translate(lpad(CAST(read_key AS STRING), 10, '0'), '0123456789', 'ACGTTGCAAC'), translate(lpad(CAST(other AS STRING), 10, '0'), '0123456789', 'GATCTACGGT')) AS template,
           concat(repeat(chr(33 + q), 8), repeat(chr(33 + (q + 11) % 41), 7), repeat(chr(33 + (q + 23) % 41), 5)) AS tqual,
           concat(repeat(chr(33 + (q + 5) % 41), {n - 4}), repeat(chr(33 + q), 4)) AS bqual
    FROM (SELECT *, CASE WHEN other % 7 = 0 THEN {changed("b1", f"1 + other % {n - 2}")} ELSE b1 END AS b2
      FROM (SELECT *, CASE WHEN other % 3 = 0 THEN {changed("b0", f"1 + other % {n}")} ELSE b0 END AS b1
        FROM (SELECT CAST({key} AS BIGINT) AS read_key, CAST({other} AS BIGINT) AS other, {filtered} AS filtered, {control} AS control, CAST({quality} AS INT) % 41 AS q,
                {barcode_sql(f"({key} % 32)", times)} AS b0 {extra} FROM {source}) x0) x1) x2"""


ORDERS = ("orders", "o_orderkey", "o_custkey", "CASE WHEN o_orderstatus = 'P' THEN 'Y' ELSE 'N' END", "CASE WHEN o_custkey % 13 = 0 THEN '1' ELSE '0' END", "o_orderkey % 41")
LINES = ("lineitem", "l_orderkey", "l_partkey", "CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END", "CASE WHEN l_partkey % 13 = 0 THEN '1' ELSE '0' END", "l_quantity")


def reads(spark: SparkSession, sf_dir: str, of: tuple[str, ...], times: int, *columns: str, source: DataFrame | None = None) -> DataFrame:
    """These columns of the reads, as rows of a generator: the optimiser then leaves the nested text of their making where it is, as if they were scanned."""
    source = spark.read.parquet(f"{sf_dir}/{of[0]}.parquet") if source is None else source
    made = spark.sql(reads_sql("{source}", *of[1:], times), source=source)
    return made.select(F.explode(F.array(F.struct(*columns))).alias("r")).select("r.*")


def samples(spark: SparkSession, sf_dir: str, times: int) -> list[Sample]:
    """The sample table, 25 rows whatever the scale, as the driver reads it from a sheet."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    code = lambda k: "".join("ACGT"[k // d % 4] * times for d in (16, 4, 1))
    found = [Sample(r["n_name"], project=r["r_name"], barcode=code(r["n_nationkey"]), ordinal=i) for i, r in enumerate(rows)]
    return [*found, Sample("Undetermined", barcode="N" * 3 * times, ordinal=len(found))]


SAMPLES_15, SAMPLES_9 = (f"SELECT CAST(n_nationkey AS INT) AS ordinal, n_name AS sample_id, r_name AS project, {barcode_sql('n_nationkey', t)} AS barcode FROM nation JOIN region ON n_regionkey = r_regionkey" for t in (5, 3))


def demultiplexer(spark: SparkSession, sf_dir: str, times: int = 5, **rules) -> Demultiplexer:
    """Two FASTQs: barcode and UMI, and a template of 20 bases."""
    return Demultiplexer(samples(spark, sf_dir, times), [ReadStructure.parse(f"{3 * times}B6M"), ReadStructure.parse("+T")], ["T"], Rules(**rules))


def templates(spark: SparkSession, sf_dir: str, of: tuple[str, ...], times: int = 5, keep: tuple[str, ...] = ("read_key",), parts: tuple[str, ...] = ("head", "seq", "qual"), source: DataFrame | None = None) -> DataFrame:
    """Two FASTQs with the parts that a query reads, from their table or a stream of its rows."""
    made = {
        "head_0": (["head"], F.col("head")),
        "seq_0": (["bc", "umi"], F.concat("bc", "umi")),
        "qual_0": (["bqual"], F.concat("bqual", F.lit("IIIIII"))),
        "head_1": (["head"], F.col("head")),
        "seq_1": (["template"], F.col("template")),
        "qual_1": (["tqual"], F.col("tqual")),
    }
    wanted = {f"{p}_{i}": made[f"{p}_{i}"] for i in range(2) for p in parts}
    r = reads(spark, sf_dir, of, times, *dict.fromkeys([*keep, *[c for needs, _ in wanted.values() for c in needs]]), source=source)
    return r.select(*keep, *[value.alias(name) for name, (_, value) in wanted.items()])


# --- rows -----------------------------------------------------------------------------------------------------------


def parse_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir, ORDERS, 5, "read_key", "head").withColumn("h", H.parse_header(F.col("head")))
    h = F.col("h")
    return r.select("read_key", h["instrument"].alias("instrument"), h["lane"].alias("lane"), h["x_pos"].alias("x_pos"), h["y_pos"].alias("y_pos"), h["read_number"].alias("read_number"), h["sample_barcode"].alias("sample_barcode"), H.is_control(h).alias("is_control"), H.is_failed_quality_filter(h).alias("is_failed"))


PARSE_HEADER = f"""
WITH r AS ({reads_sql(*ORDERS, 5)}), p AS (SELECT read_key, string_split(split_part(head, ' ', 1), ':') AS n, string_split(split_part(head, ' ', 2), ':') AS i FROM r)
SELECT read_key, n[1] AS instrument, n[4] AS lane, n[6] AS x_pos, n[7] AS y_pos, i[1] AS read_number, i[4] AS sample_barcode, i[3] <> '0' AS is_control, i[2] = 'Y' AS is_failed FROM p"""


def rewrite_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demultiplexer(spark, sf_dir)
    t = d.with_barcodes(templates(spark, sf_dir, ORDERS))
    return d.with_headers(t).select("read_key", d.record(1, "T")[0].alias("new_head"))


REWRITE_HEADER = f"""
WITH r AS ({reads_sql(*ORDERS, 5)})
SELECT read_key, concat(split_part(head, ' ', 1), ':', umi, ' ', regexp_replace(split_part(head, ' ', 2), ':NNNNNNNN$', ''), ':', bc) AS new_head FROM r"""


def extract_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reads(spark, sf_dir, ORDERS, 5, "read_key", "head", "bc", "umi", "template", "bqual", "tqual")
    read = G.Read(F.col("head"), F.concat("bc", "umi", "template"), F.concat("bqual", F.lit("IIIIII"), "tqual"))
    s = ReadStructure.parse("7B6M8B3S4T5S+T")
    cut = t.select("read_key", *[G.joined(read, s, k).alias(f"{k.lower()}_bases") for k in "TBMS"], G.joined(read, s, "T", "qual").alias("t_quals"))
    return cut.withColumn("b_delim", F.concat_ws("+", F.substring("b_bases", 1, 7), F.substring("b_bases", 8, 8)))


EXTRACT_SEGMENTS = f"""
WITH r AS ({reads_sql(*ORDERS, 5)}), s AS (SELECT read_key, concat(bc, umi, template) AS s, concat(bqual, 'IIIIII', tqual) AS q FROM r)
SELECT read_key, concat(substr(s, 25, 4), substr(s, 34)) AS t_bases, concat(substr(s, 1, 7), substr(s, 14, 8)) AS b_bases, substr(s, 8, 6) AS m_bases,
       concat(substr(s, 22, 3), substr(s, 29, 5)) AS s_bases, concat(substr(q, 25, 4), substr(q, 34)) AS t_quals, concat(substr(s, 1, 7), '+', substr(s, 14, 8)) AS b_delim FROM s"""


def mask_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir, ORDERS, 5, "read_key", "template", "tqual")
    return r.select("read_key", *[G.mask(F.col("template"), F.col("tqual"), t).alias(f"masked_{t}") for t in (0, 15, 30)])


_masked = "array_to_string(list_transform(range(1, 21), lambda i: CASE WHEN ascii(substr(tqual, i, 1)) - 33 < {t} THEN 'N' ELSE substr(template, i, 1) END), '')"
MASK_QUALITY = f"WITH r AS ({reads_sql(*ORDERS, 5)}) SELECT read_key, template AS masked_0, {_masked.format(t=15)} AS masked_15, {_masked.format(t=30)} AS masked_30 FROM r"


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir, ORDERS, 5, "read_key", "tqual", "bqual", "bc")
    return r.select("read_key", G.q20_bases(F.col("tqual")).alias("q20"), G.q30_bases(F.col("tqual")).alias("q30"), G.quality_sum(F.col("bqual"), 15).alias("index_sum"), G.n_calls(F.col("bc")).cast("long").alias("n_calls"))


_atleast = "CAST(len(list_filter(range(1, 21), lambda i: ascii(substr(tqual, i, 1)) - 33 >= {t})) AS BIGINT)"
QUALITY_COUNTS = f"""
WITH r AS ({reads_sql(*ORDERS, 5)})
SELECT read_key, {_atleast.format(t=20)} AS q20, {_atleast.format(t=30)} AS q30, CAST(list_sum(list_transform(range(1, 16), lambda i: ascii(substr(bqual, i, 1)) - 33)) AS BIGINT) AS index_sum,
       CAST(length(bc) - length(replace(bc, 'N', '')) AS BIGINT) AS n_calls FROM r"""


def filter_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demultiplexer(spark, sf_dir, filter_control_reads=True, filter_failing_quality=True)
    return d.with_drop_reason(templates(spark, sf_dir, ORDERS, parts=("head",))).select("read_key", F.coalesce("drop_reason", F.lit("kept")).alias("outcome"))


_reason = "CASE WHEN split_part(split_part(head, ' ', 2), ':', 2) = 'Y' THEN 'quality' WHEN split_part(split_part(head, ' ', 2), ':', 3) <> '0' THEN 'control' END"
FILTER_READS = f"WITH r AS ({reads_sql(*ORDERS, 5)}) SELECT read_key, coalesce({_reason}, 'kept') AS outcome FROM r"


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demultiplexer(spark, sf_dir, filter_control_reads=True, filter_failing_quality=True)
    return R.run_counts(d.with_drop_reason(templates(spark, sf_dir, LINES, keep=(), parts=("head",))))


RUN_METRICS = f"""
WITH r AS ({reads_sql(*LINES, 5)}), d AS (SELECT {_reason} AS why FROM r)
SELECT count(*) FILTER (why = 'control') AS control_reads_omitted, count(*) FILTER (why = 'quality') AS failing_reads_omitted, count(*) FILTER (why IS NULL) AS total_templates FROM d"""


def no_call_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demultiplexer(spark, sf_dir, max_no_calls=0)
    return d.assign(templates(spark, sf_dir, ORDERS, parts=("head", "seq"))).select("read_key", "sample_ordinal", "matched")


def _cached_sql(of: tuple[str, ...], m: int = 1, delta: int = 2, extra: str = "true", times: int = 5) -> str:
    """CTEs r (reads), s (samples) and a (assigned: ordinal 25 and matched false where nothing matches)."""
    return f"""
    r AS ({reads_sql(*of, times)}), s AS ({SAMPLES_15 if times == 5 else SAMPLES_9}),
    b AS (SELECT DISTINCT bc FROM r),
    d AS (SELECT bc, ordinal, hamming(bc, barcode) - n + greatest(0, n - 1) AS dist FROM (SELECT *, length(bc) - length(replace(bc, 'N', '')) AS n FROM b CROSS JOIN s)),
    k AS (SELECT bc, min(dist) AS best, arg_min(ordinal, dist * 1000 + ordinal) AS ordinal FROM d GROUP BY bc),
    g AS (SELECT k.bc, k.best, k.ordinal, min(d.dist) AS second FROM k JOIN d ON k.bc = d.bc AND k.ordinal <> d.ordinal GROUP BY ALL),
    a AS (SELECT r.*, coalesce(m.ordinal, 25) AS sample_ordinal, m.best AS hamming_dist, m.ordinal IS NOT NULL AS matched
          FROM r LEFT JOIN (SELECT * FROM g WHERE best <= {m} AND second - best > {delta} AND {extra}) m ON r.bc = m.bc)"""


NO_CALL_FILTER = f"WITH {_cached_sql(ORDERS, extra="bc NOT LIKE '%N%'")} SELECT read_key, CAST(sample_ordinal AS INT) AS sample_ordinal, matched FROM a"


def hamming_free_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir, ORDERS, 5, "read_key", "bc")
    expected = samples(spark, sf_dir, 5)[7].barcode
    n = G.n_calls(F.col("bc"))
    d = M.distance(M.one_hot(F.col("bc"), 15), F.length("bc"), expected)
    return r.select("read_key", d.cast("int").alias("strict"), *[(d - n + F.greatest(n - f, F.lit(0))).cast("int").alias(f"free_{f}") for f in (0, 1, 2)])


HAMMING_FREE_N = f"""
WITH r AS ({reads_sql(*ORDERS, 5)}), d AS (SELECT read_key, hamming(bc, barcode) AS d, length(bc) - length(replace(bc, 'N', '')) AS n FROM r CROSS JOIN ({SAMPLES_15}) s WHERE ordinal = 7)
SELECT read_key, CAST(d AS INT) AS strict, {", ".join(f"CAST(d - n + greatest(n - {f}, 0) AS INT) AS free_{f}" for f in (0, 1, 2))} FROM d"""


def match_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demultiplexer(spark, sf_dir, allowed_mismatches=2, min_delta=1)
    return d.assign(templates(spark, sf_dir, ORDERS, parts=("head", "seq"))).select("read_key", "sample_ordinal", F.coalesce("hamming_dist", F.lit(-1)).alias("hamming_dist"))


MATCH_CACHED = f"WITH {_cached_sql(ORDERS, 2, 1)} SELECT read_key, CAST(sample_ordinal AS INT) AS sample_ordinal, CAST(coalesce(hamming_dist, -1) AS INT) AS hamming_dist FROM a"


def match_precompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demultiplexer(spark, sf_dir, 3)
    return d.assign(templates(spark, sf_dir, ORDERS, 3, parts=("head", "seq"))).select("read_key", "sample_ordinal", F.coalesce("hamming_dist", F.lit(-1)).alias("hamming_dist"))


def _precompute_sql(of: tuple[str, ...], times: int) -> str:
    """As _cached_sql(), by the other rule."""
    return f"""
    r AS ({reads_sql(*of, times)}), s AS ({SAMPLES_15 if times == 5 else SAMPLES_9}), b AS (SELECT DISTINCT bc FROM r),
    d AS (SELECT bc, ordinal, hamming(bc, barcode) AS dist, CASE WHEN bc LIKE '%N%' THEN 1 ELSE 0 END AS n FROM b CROSS JOIN s),
    k AS (SELECT bc, min(dist) AS best, arg_min(ordinal, dist * 1000 + ordinal) AS ordinal FROM d GROUP BY bc),
    c AS (SELECT k.bc, k.best, k.ordinal, count(*) FILTER ((dist <= 1 OR (dist - n >= 2 AND dist <= 2)) AND dist - best <= 2) AS rivals FROM k JOIN d ON k.bc = d.bc GROUP BY ALL),
    a AS (SELECT read_key, coalesce(c.ordinal, 25) AS sample_ordinal, best AS hamming_dist FROM r LEFT JOIN (SELECT * FROM c WHERE best <= 1 AND rivals = 1) c ON r.bc = c.bc)"""


MATCH_PRECOMPUTE = f"WITH {_precompute_sql(ORDERS, 3)} SELECT read_key, CAST(sample_ordinal AS INT) AS sample_ordinal, CAST(coalesce(hamming_dist, -1) AS INT) AS hamming_dist FROM a"


def zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir, ORDERS, 5, "read_key", "head", "bc", "bqual", "template", "tqual")
    first = r.select("read_key", "head", F.col("bc").alias("seq"), F.col("bqual").alias("qual"))
    second = r.select("read_key", "head", F.col("template").alias("seq"), F.col("tqual").alias("qual"))
    return zip_reads([first, second], ["read_key"]).select("read_key", "seq_0", "seq_1", (F.col("head_0") == F.col("head_1")).alias("same_head"))


ZIP_JOIN = f"WITH r AS ({reads_sql(*ORDERS, 5)}) SELECT x.read_key, x.bc AS seq_0, y.template AS seq_1, x.head = y.head AS same_head FROM r x JOIN r y ON x.read_key = y.read_key"


# --- reports --------------------------------------------------------------------------------------------------------


def _per_sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Demultiplexer]:
    d = demultiplexer(spark, sf_dir)
    counted = R.per_sample_counts(d.report_rows(templates(spark, sf_dir, LINES, keep=())))
    return R.with_all_samples(counted, R.sample_table(spark, d.samples)), d


def _rounded(report: DataFrame, *keep: str) -> DataFrame:
    return report.select(*keep, *R.REPORT[:8], *[F.round(c, 6).alias(c) for c in R.REPORT[8:]])


def per_sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.report(_per_sample(spark, sf_dir)[0]), "ordinal")


def per_project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, d = _per_sample(spark, sf_dir)
    return _rounded(R.report(R.per_project_counts(counts, len(d.samples[0].barcode))))


_list_q = "list_transform(range(1, {n}), lambda i: ascii(substr({q}, i, 1)) - 33)"
_quality_sql = f"""
    q AS (SELECT sample_ordinal AS ordinal, matched, hamming_dist, {_list_q.format(n=21, q="tqual")} AS t, {_list_q.format(n=16, q="bqual")} AS i FROM a),
    c AS (SELECT ordinal, count(*) AS total_matches, count(*) FILTER (matched AND hamming_dist = 0) AS perfect_matches, count(*) FILTER (matched AND hamming_dist = 1) AS one_mismatch_matches,
                 CAST(sum(len(list_filter(t, lambda x: x >= 20))) AS BIGINT) AS q20_bases, CAST(sum(len(list_filter(t, lambda x: x >= 30))) AS BIGINT) AS q30_bases,
                 CAST(sum(len(t)) AS BIGINT) AS total_number_of_bases, CAST(sum(list_sum(i)) AS BIGINT) AS isum, CAST(sum(len(i)) AS BIGINT) AS ibases FROM q GROUP BY ordinal),
    al AS (SELECT ordinal, sample_id, project, barcode FROM s UNION ALL SELECT 25, 'Undetermined', NULL, repeat('N', 15))"""
_ratios = """round(total_matches / CAST(sum(total_matches) OVER () AS DOUBLE), 6) AS fraction_matches,
    round(total_matches / CAST(max(CASE WHEN last THEN NULL ELSE total_matches END) OVER () AS DOUBLE), 6) AS ratio_this_barcode_to_best_barcode,
    round(q20_bases / CAST(total_number_of_bases AS DOUBLE), 6) AS frac_q20_bases, round(q30_bases / CAST(total_number_of_bases AS DOUBLE), 6) AS frac_q30_bases,
    round(isum / CAST(ibases AS DOUBLE), 6) AS mean_index_base_quality"""
_counts = "total_matches, perfect_matches, one_mismatch_matches, q20_bases, q30_bases, total_number_of_bases"
PER_SAMPLE = f"""
WITH {_cached_sql(LINES)}, {_quality_sql}
SELECT CAST(al.ordinal AS INT) AS ordinal, sample_id AS "sample_ID", barcode, {_counts}, {_ratios} FROM (SELECT *, ordinal = 25 AS last FROM c) c JOIN al ON c.ordinal = al.ordinal"""
PER_PROJECT = f"""
WITH {_cached_sql(LINES)}, {_quality_sql},
p AS (SELECT CASE WHEN c.ordinal = 25 THEN 'Undetermined' ELSE project END AS sample_id, c.ordinal = 25 AS last, {", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in (*_counts.split(", "), "isum", "ibases"))} FROM c JOIN al ON c.ordinal = al.ordinal GROUP BY 1, 2)
SELECT sample_id AS "sample_ID", repeat('N', 15) AS barcode, {_counts}, {_ratios} FROM p"""


def top_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demultiplexer(spark, sf_dir)
    return R.most_frequent(R.unmatched_counts(d.report_rows(templates(spark, sf_dir, LINES, keep=()))), 100)


TOP_UNMATCHED = f"WITH {_cached_sql(LINES)} SELECT bc AS barcode, count(*) AS count FROM a WHERE NOT matched GROUP BY bc ORDER BY 2 DESC, 1 LIMIT 100"


def merged_lane_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of even and odd keys as two lanes, each summed up to a state that is kept; the reports come from the merged states."""
    d, folder = demultiplexer(spark, sf_dir), f"{shared_folder(spark)}/lanes-{uuid.uuid4().hex}"
    for lane in range(2):
        P.save(P.state_of(d, templates(spark, sf_dir, LINES).filter(F.col("read_key") % 2 == lane)), folder, f"L{lane}")
    counted = R.per_sample_counts(P.report_rows(d, P.merged(spark, folder))[1])
    return _rounded(R.report(R.with_all_samples(counted, R.sample_table(spark, d.samples))), "ordinal")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by sample of a stream of the reads, as they stand when all have come: state is a row a sample."""
    path, folder = f"{sf_dir}/{LINES[0]}.parquet", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")  # a pattern, as streams take no single file
    counts = running_counts(templates(spark, sf_dir, LINES, keep=(), source=stream), demultiplexer(spark, sf_dir))
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/counts")
    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/counts").select("ordinal", *R.COUNTS)


STREAMED_COUNTS = f"""
WITH {_cached_sql(LINES)}, {_quality_sql}
SELECT CAST(ordinal AS INT) AS ordinal, {_counts}, isum AS index_quality_sum, ibases AS index_bases FROM c"""


#: Counters of a sketch that is much smaller than the number of unmatched barcodes.
SKETCH_SIZE = 40


def frequent_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched barcodes with more than one read in 41, found by a sketch of 40 counters, with their exact counts and whether the sketch's bounds hold them."""
    d = demultiplexer(spark, sf_dir)
    unmatched = d.assign(templates(spark, sf_dir, LINES, keep=(), parts=("head", "seq"))).filter("NOT matched").select("bc_delim")
    found = frequent_exact(unmatched, SKETCH_SIZE)
    tight = (F.col("at_most") - F.col("at_least")) * (SKETCH_SIZE + 1) <= F.col("rows")
    return found.select(F.col("value").alias("barcode"), "n", F.col("n").between(F.col("at_least"), F.col("at_most")).alias("within"), tight.alias("tight"))


FREQUENT_UNMATCHED = f"""
WITH {_cached_sql(LINES)}, u AS (SELECT bc FROM a WHERE NOT matched)
SELECT bc AS barcode, count(*) AS n, TRUE AS within, TRUE AS tight FROM u GROUP BY bc HAVING count(*) * {SKETCH_SIZE + 1} > (SELECT count(*) FROM u)"""


def barcode_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The barcode in two reads of 5 and 10 bases, the second half of reads of odd part keys from another sample."""
    base = demultiplexer(spark, sf_dir)
    d = Demultiplexer(base.samples, [ReadStructure.parse("5B"), ReadStructure.parse("10B6M"), ReadStructure.parse("+T")], ["T"], base.rules)
    t = templates(spark, sf_dir, LINES, keep=())
    cut = lambda part, at, n: F.substring(f"{part}_0", at, n)
    split = t.select(
        "head_0", *[cut(p, 1, 5).alias(f"{p}_0") for p in ("seq", "qual")],
        "head_1", *[cut(p, 6, 16).alias(f"{p}_1") for p in ("seq", "qual")],
        *[F.col(f"{p}_1").alias(f"{p}_2") for p in ("head", "seq", "qual")],
    )
    return R.hop_counts(d.report_rows(split), *d.hop_lengths, d.samples)


BARCODE_HOPS = f"""
WITH {_cached_sql(LINES)}, h AS (SELECT substr(barcode, 1, 5) AS x, substr(barcode, 6) AS y FROM (SELECT barcode FROM s UNION ALL SELECT repeat('N', 15)))
SELECT concat(substr(bc, 1, 5), '+', substr(bc, 6)) AS barcode, count(*) AS count FROM a
WHERE NOT matched AND ((substr(bc, 1, 5) IN (SELECT x FROM h) AND substr(bc, 6) IN (SELECT y FROM h)) OR (substr(bc, 11) IN (SELECT x FROM h) AND substr(bc, 1, 10) IN (SELECT y FROM h))) GROUP BY bc"""


def output_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandsort.sources.sink import output_names

    d = demultiplexer(spark, sf_dir)
    d = Demultiplexer(d.samples, d.structures, ["T", "M"], d.rules)
    names = output_names(d.samples, d.structures, d.output_kinds)
    table = spark.createDataFrame([(o, k, n) for (o, k), n in names.items()], "sample_ordinal int, output int, path string")
    records = d.output_records(d.assign(templates(spark, sf_dir, LINES, keep=())), [])
    return records.groupBy("sample_ordinal", "output").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.length("seq")).alias("n_bases")).join(F.broadcast(table), ["sample_ordinal", "output"]).select("path", "n_records", "n_bases")


OUTPUT_ROUTING = f"""
WITH {_cached_sql(LINES)}, al AS (SELECT ordinal, sample_id, project FROM s UNION ALL SELECT 25, 'Undetermined', NULL),
o AS (SELECT sample_ordinal, u.k AS k, u.n AS n FROM a CROSS JOIN (VALUES ('U', 6), ('R', 20)) u(k, n))
SELECT concat(coalesce(project || '/', ''), sample_id, '_S', CAST(ordinal + 1 AS VARCHAR), '_L001_', k, '1_001.fastq.gz') AS path, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_bases
FROM o JOIN al ON o.sample_ordinal = al.ordinal GROUP BY 1"""


def semantic_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised and reported barcodes of raw sheet columns, for sheets that come as tables."""
    from strandsort.functions.sheets import sanitized, semantic

    raw = spark.sql("SELECT c_custkey, concat(substr(c_name, 1, 3), 'acgtn-', CAST(c_custkey AS STRING), 'TTGA') AS raw, CASE WHEN c_custkey % 3 = 0 THEN 'acG' END AS i1, CASE WHEN c_custkey % 2 = 0 THEN 'TTn' END AS i2 FROM {c}", c=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    raw = raw.withColumn("raw", F.when(F.col("i1").isNull() & F.col("i2").isNull(), F.col("raw")))
    return raw.select("c_custkey", sanitized(F.coalesce("raw", F.concat_ws("", "i1", "i2"))).alias("barcode"), semantic(F.col("raw"), F.col("i1"), F.col("i2")).alias("semantic"))


SEMANTIC_BARCODE = """
WITH x AS (SELECT c_custkey, concat(substr(c_name, 1, 3), 'acgtn-', CAST(c_custkey AS VARCHAR), 'TTGA') AS raw0, CASE WHEN c_custkey % 3 = 0 THEN 'acG' END AS i1, CASE WHEN c_custkey % 2 = 0 THEN 'TTn' END AS i2 FROM customer),
y AS (SELECT c_custkey, CASE WHEN i1 IS NULL AND i2 IS NULL THEN raw0 END AS raw, i1, i2 FROM x),
z AS (SELECT *, regexp_replace(upper(coalesce(raw, concat(i1, i2))), '[^ACGT]', '', 'g') AS barcode FROM y)
SELECT c_custkey, barcode, CASE WHEN i1 IS NOT NULL AND i2 IS NOT NULL THEN i1 || '+' || i2 ELSE coalesce(raw, barcode) END AS semantic FROM z"""


def coalesce_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one id and barcode over lanes become one; the lane goes (0 here) if there were several; numbered by line."""
    from strandsort.functions.sheets import coalesced

    rows = spark.sql("SELECT concat('S', CAST(o_custkey AS STRING)) AS sample_id, substr('ACGTACGT', 1 + CAST(o_custkey % 4 AS INT), 4) AS barcode, CAST(1 + o_orderkey % 4 AS INT) AS lane, o_orderkey AS line_number FROM {o}", o=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return coalesced(rows, [1, 2, 3]).withColumn("lane", F.coalesce("lane", F.lit(0)))


COALESCE_SAMPLES = """
WITH x AS (SELECT concat('S', CAST(o_custkey AS VARCHAR)) AS sample_id, substr('ACGTACGT', 1 + CAST(o_custkey % 4 AS INT), 4) AS barcode, CAST(1 + o_orderkey % 4 AS INT) AS lane, o_orderkey AS line_number FROM orders),
g AS (SELECT sample_id, barcode, CASE WHEN count(*) = 1 THEN min(lane) ELSE 0 END AS lane, min(line_number) AS line_number FROM x WHERE lane IN (1, 2, 3) GROUP BY 1, 2)
SELECT sample_id, barcode, lane, line_number, row_number() OVER (ORDER BY line_number) - 1 AS ordinal FROM g"""


def sample_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of sample barcodes, and how often the first one's own barcode was read."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    s = spark.sql(SAMPLES_15.replace("nation ", "{nation} ").replace("region ", "{region} "), nation=nation, region=region)
    s = s.select("ordinal", "barcode", M.one_hot(F.col("barcode"), 15)[0].alias("bits"))
    a, b = (s.select(*[F.col(c).alias(f"{c}_{x}") for c in s.columns]) for x in "ab")
    counts = reads(spark, sf_dir, LINES, 5, "bc").groupBy("bc").agg(F.count(F.lit(1)).alias("n"))
    pairs = a.join(F.broadcast(b), F.col("ordinal_a") < F.col("ordinal_b"))  # samples of a sheet
    pairs = pairs.select(F.col("ordinal_a").alias("a"), F.col("ordinal_b").alias("b"), (15 - F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))).cast("int").alias("distance"), F.col("barcode_a").alias("bc"))
    own = counts.join(F.broadcast(s.select(F.col("barcode").alias("bc"))), "bc", "left_semi")
    return pairs.join(own, "bc", "left").select("a", "b", "distance", F.coalesce("n", F.lit(0)).alias("reads_of_a"))


SAMPLE_PAIR_DISTANCES = f"""
WITH r AS ({reads_sql(*LINES, 5)}), s AS ({SAMPLES_15}), c AS (SELECT bc, count(*) AS n FROM r GROUP BY bc)
SELECT a.ordinal AS a, b.ordinal AS b, CAST(hamming(a.barcode, b.barcode) AS INT) AS distance, coalesce(c.n, 0) AS reads_of_a FROM s a JOIN s b ON a.ordinal < b.ordinal LEFT JOIN c ON c.bc = a.barcode"""

# --- other ways to run ---------------------------------------------------------------------------------------------


def header_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample barcode as the header has it, in two parts; reads without barcode segments."""
    base = demultiplexer(spark, sf_dir)
    d = Demultiplexer(base.samples, [ReadStructure.parse("6M+T")], ["T"], Rules(barcode_in_header=True))
    r = reads(spark, sf_dir, ORDERS, 5, "read_key", "head", "bc", "umi", "template")
    told = F.concat(F.regexp_replace("head", "NNNNNNNN$", ""), F.substring("bc", 1, 7), F.lit("+"), F.substring("bc", 8, 8))
    t = r.select("read_key", told.alias("head_0"), F.concat("umi", "template").alias("seq_0"))
    return d.assign(t).select("read_key", "bc", "bc_delim", "umi_delim", "sample_ordinal")


HEADER_BARCODE = f"""
WITH {_cached_sql(ORDERS)}
SELECT read_key, bc, concat(substr(bc, 1, 7), '+', substr(bc, 8)) AS bc_delim, umi AS umi_delim, CAST(sample_ordinal AS INT) AS sample_ordinal FROM a"""


def no_demultiplexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample without barcode takes all reads, none of which counts as matched."""
    d = Demultiplexer([Sample("all", ordinal=0)], [ReadStructure.parse("15B6M"), ReadStructure.parse("+T")], ["T"], Rules(filter_failing_quality=True))
    counts = R.per_sample_counts(d.report_rows(templates(spark, sf_dir, LINES, keep=())))
    return counts.select("ordinal", *R.COUNTS)


NO_DEMULTIPLEXING = f"""
WITH r AS ({reads_sql(*LINES, 5)}), q AS (SELECT {_list_q.format(n=21, q="tqual")} AS t, {_list_q.format(n=16, q="bqual")} AS i FROM r WHERE filtered_of(head) <> 'Y')
SELECT 0 AS ordinal, count(*) AS total_matches, CAST(0 AS BIGINT) AS perfect_matches, CAST(0 AS BIGINT) AS one_mismatch_matches,
       CAST(sum(len(list_filter(t, lambda x: x >= 20))) AS BIGINT) AS q20_bases, CAST(sum(len(list_filter(t, lambda x: x >= 30))) AS BIGINT) AS q30_bases,
       CAST(sum(len(t)) AS BIGINT) AS total_number_of_bases, CAST(sum(list_sum(i)) AS BIGINT) AS index_quality_sum, CAST(sum(len(i)) AS BIGINT) AS index_bases FROM q""".replace("filtered_of(head)", "split_part(split_part(head, ' ', 2), ':', 2)")


def mask_per_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold for each FASTQ: templates are masked by that of their own, barcodes and UMIs by none."""
    base = demultiplexer(spark, sf_dir)
    d = Demultiplexer(base.samples, [ReadStructure.parse("15B6M4T"), ReadStructure.parse("+T")], ["T", "M"], Rules(mask_thresholds=(20, 10)))
    t = templates(spark, sf_dir, ORDERS).withColumns({"seq_0": F.concat("seq_0", F.substring("seq_1", 1, 4)), "qual_0": F.concat("qual_0", F.substring("qual_1", 6, 4))})
    rows = d.output_records(d.with_barcodes(t).withColumn("sample_ordinal", F.lit(0)), ["read_key"])
    return rows.select("read_key", F.col("output").cast("int").alias("output"), "seq", "qual")


_masked_part = "array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN ascii(substr(q, i, 1)) - 33 < {t} THEN 'N' ELSE substr(s, i, 1) END), '')"
MASK_PER_FASTQ = f"""
WITH r AS ({reads_sql(*ORDERS, 5)}),
p AS (SELECT read_key, 0 AS output, umi AS s, 'IIIIII' AS q, 0 AS t FROM r UNION ALL
      SELECT read_key, 1, substr(template, 1, 4), substr(tqual, 6, 4), 20 FROM r UNION ALL SELECT read_key, 2, template, tqual, 10 FROM r)
SELECT read_key, CAST(output AS INT) AS output, {_masked_part.format(t="t")} AS seq, q AS qual FROM p"""


def output_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every kind as outputs of their own, numbered by kind over the FASTQs."""
    from strandsort.sources.sink import output_names

    base = demultiplexer(spark, sf_dir)
    d = Demultiplexer(base.samples, [ReadStructure.parse("9B3S6B3M"), ReadStructure.parse("4S6T2M+T")], ["S", "M", "T", "B"])
    names = output_names(d.samples[:1], d.structures, d.output_kinds)
    table = spark.createDataFrame([(k, n.split("_L001_")[1]) for (_, k), n in names.items()], "output int, file string")
    t = templates(spark, sf_dir, ORDERS).withColumn("seq_0", F.concat(F.substring("seq_0", 1, 9), F.lit("GAT"), F.substring("seq_0", 10, 9)))
    return d.output_records(d.assign(t), ["read_key"]).join(F.broadcast(table), "output").select("read_key", "sample_ordinal", "file", "seq", "qual")


OUTPUT_TYPES = f"""
WITH {_cached_sql(ORDERS)}, q AS (SELECT *, concat(bqual, 'IIIIII') AS q0 FROM a), p AS (
SELECT read_key, sample_ordinal, 'I1' AS f, bc AS seq, concat(substr(q0, 1, 9), substr(q0, 13, 6)) AS qual FROM q UNION ALL
SELECT read_key, sample_ordinal, 'U1', substr(umi, 1, 3), substr(q0, 19, 3) FROM q UNION ALL
SELECT read_key, sample_ordinal, 'S1', 'GAT', substr(q0, 10, 3) FROM q UNION ALL
SELECT read_key, sample_ordinal, 'U2', substr(template, 11, 2), substr(tqual, 11, 2) FROM q UNION ALL
SELECT read_key, sample_ordinal, 'S2', substr(template, 1, 4), substr(tqual, 1, 4) FROM q UNION ALL
SELECT read_key, sample_ordinal, 'R1', concat(substr(template, 5, 6), substr(template, 13)), concat(substr(tqual, 5, 6), substr(tqual, 13)) FROM q)
SELECT read_key, CAST(sample_ordinal AS INT) AS sample_ordinal, concat(f, '_001.fastq.gz') AS file, seq, qual FROM p"""


#: Bases a third of the barcode, what is asked for and whether strictly, what is taken.
CHOICES = (
    (3, None, False, "precompute"),
    (3, M.MatcherKind.CACHED, False, "precompute"),
    (3, M.MatcherKind.CACHED, True, "cached"),
    (5, None, False, "cached"),
    (5, M.MatcherKind.PRECOMPUTE, False, "precompute"),
)


def matcher_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rule finds that is taken for short and long barcodes, without and with an override."""
    out = []
    for i, (times, asked, strict, _) in enumerate(CHOICES):
        d = demultiplexer(spark, sf_dir, times, matcher=asked, strict_override=strict)
        assigned = d.assign(templates(spark, sf_dir, ORDERS, times, keep=(), parts=("head", "seq")))
        out.append(assigned.groupBy("sample_ordinal").agg(F.count(F.lit(1)).alias("n_reads")).select(F.lit(i).alias("choice"), "sample_ordinal", "n_reads"))
    return reduce(DataFrame.unionByName, out)


MATCHER_CHOICE = " UNION ALL ".join(
    f"SELECT {i} AS choice, CAST(sample_ordinal AS INT) AS sample_ordinal, count(*) AS n_reads FROM (WITH {(_cached_sql if taken == 'cached' else _precompute_sql)(ORDERS, times=times)} SELECT sample_ordinal FROM a) z{i} GROUP BY sample_ordinal"
    for i, (times, _, _, taken) in enumerate(CHOICES)
)


_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "parse_header": (parse_header, PARSE_HEADER),
    "rewrite_header": (rewrite_header, REWRITE_HEADER),
    "extract_segments": (extract_segments, EXTRACT_SEGMENTS),
    "mask_quality": (mask_quality, MASK_QUALITY),
    "quality_counts": (quality_counts, QUALITY_COUNTS),
    "filter_reads": (filter_reads, FILTER_READS),
    "run_metrics": (run_metrics, RUN_METRICS),
    "no_call_filter": (no_call_filter, NO_CALL_FILTER),
    "hamming_free_n": (hamming_free_n, HAMMING_FREE_N),
    "match_cached": (match_cached, MATCH_CACHED),
    "match_precompute": (match_precompute, MATCH_PRECOMPUTE),
    "zip_join": (zip_join, ZIP_JOIN),
    "per_sample_metrics": (per_sample_metrics, PER_SAMPLE),
    "per_project_metrics": (per_project_metrics, PER_PROJECT),
    "top_unmatched": (top_unmatched, TOP_UNMATCHED),
    "merged_lane_metrics": (merged_lane_metrics, PER_SAMPLE),
    "streamed_counts": (streamed_counts, STREAMED_COUNTS),
    "frequent_unmatched": (frequent_unmatched, FREQUENT_UNMATCHED),
    "barcode_hops": (barcode_hops, BARCODE_HOPS),
    "output_routing": (output_routing, OUTPUT_ROUTING),
    "semantic_barcode": (semantic_barcode, SEMANTIC_BARCODE),
    "coalesce_samples": (coalesce_samples, COALESCE_SAMPLES),
    "sample_pair_distances": (sample_pair_distances, SAMPLE_PAIR_DISTANCES),
    "header_barcode": (header_barcode, HEADER_BARCODE),
    "no_demultiplexing": (no_demultiplexing, NO_DEMULTIPLEXING),
    "mask_per_fastq": (mask_per_fastq, MASK_PER_FASTQ),
    "output_types": (output_types, OUTPUT_TYPES),
    "matcher_choice": (matcher_choice, MATCHER_CHOICE),
    **table_queries.ALL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
