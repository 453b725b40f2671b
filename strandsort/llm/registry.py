"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandsort.llm import decontamination, html_extraction, jaccard_join, language_id, merkle, packing, pii, quality_rules, secret_scan, sharding, spelling_variants, token_counts, url_rules


#: Name, query and SQL (None where SQL can't express it; tests hold it against brute force).
_ALL = (
    ("op9_quality_rules", quality_rules.op9_quality_rules, quality_rules.OP9_SQL),
    ("op5_jaccard_join", jaccard_join.op5_jaccard_join, jaccard_join.OP5_SQL),
    ("op10_decontamination", decontamination.op10_decontamination, None),
    ("op7_pii", pii.op7_pii, None),
    ("op6_packing", packing.op6_packing, None),
    ("op2_sharding", sharding.op2_sharding, None),
    ("op4_token_counts", token_counts.op4_token_counts, None),
    ("op8_language_id", language_id.op8_language_id, None),
    ("op1_url_rules", url_rules.op1_url_rules, None),
    ("op3_secret_scan", secret_scan.op3_secret_scan, None),
    ("op11_merkle", merkle.op11_merkle, merkle.OP11_SQL),
    ("op12_html_text", html_extraction.op12_html_text, None),
    ("op13_spelling_variants", spelling_variants.op13_spelling_variants, spelling_variants.OP13_SQL),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _ALL if sql is not None}
