"""Sample-sheet semantics as columns, for sheets that come as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandsort.operators.numbering import numbered


def sanitized(barcode: Column) -> Column:
    return F.regexp_replace(F.upper(barcode), "[^ACGT]", "")


def semantic(raw: Column, index1: Column, index2: Column) -> Column:
    both = F.when(index1.isNotNull() & index2.isNotNull(), F.concat_ws("+", index1, index2))
    return F.coalesce(both, raw, sanitized(F.concat_ws("", index1, index2)))


def coalesced(rows: DataFrame, lanes: list[int]) -> DataFrame:
    """Rows (sample_id, barcode, lane, line_number) of the lanes, one for each id and barcode, with ordinal by line."""
    chosen = rows.filter(F.col("lane").isin(lanes)) if lanes else rows
    merged = chosen.groupBy("sample_id", "barcode").agg(F.when(F.count(F.lit(1)) == 1, F.min("lane")).alias("lane"), F.min("line_number").alias("line_number"))
    return numbered(merged, ["line_number", "sample_id", "barcode"], "ordinal")
