"""Read headers as column expressions.

``@instrument:run:flowcell:lane:tile:x:y[:umi] read:filtered:control:barcode[ other]``. All parts are text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_FIELDS = ("instrument", "run_number", "flowcell_id", "lane", "tile", "x_pos", "y_pos")
INFO_FIELDS = ("read_number", "is_filtered", "control_number", "sample_barcode")
ASCII_END_BLANKS = r"[ \t\n\x0B\f\r]+$"


def parse_header(head: Column) -> Column:
    """A struct of the name's fields, umi, has_comment, the info fields and other; a field that is missing is an error."""
    trimmed = F.regexp_replace(head, ASCII_END_BLANKS, "")
    parts = F.split(trimmed, " ", 2)
    name, comment = F.split(parts[0], ":", 8), F.get(parts, F.lit(1))
    info_other = F.split(comment, " ", 2)
    info = F.split(info_other[0], ":", 4)
    missing = lambda what: F.raise_error(F.concat(F.lit(f"Read header has no {what}: "), head))
    field = lambda a, i, what: F.coalesce(F.get(a, F.lit(i)), missing(what).cast("string"))
    has = comment.isNotNull()
    return F.struct(
        *[field(name, i, f).alias(f) for i, f in enumerate(NAME_FIELDS)],
        F.get(name, F.lit(7)).alias("umi"),
        has.alias("has_comment"),
        *[F.when(has, field(info, i, f)).alias(f) for i, f in enumerate(INFO_FIELDS)],
        F.when(has, F.get(info_other, F.lit(1))).alias("other"),
    )


def format_header(h: Column | dict[str, Column]) -> Column:
    """The header's text, from a parsed struct or its fields."""
    name = F.concat_ws(":", *[h[f] for f in NAME_FIELDS], h["umi"])
    info = F.concat_ws(":", *[h[f] for f in INFO_FIELDS])
    return F.when(h["has_comment"], F.concat_ws(" ", name, info, h["other"])).otherwise(name)


def set_sample_barcode(h: Column, barcode: Column, strict: bool = True) -> Column:
    """Replace the barcode in the comment. Without a comment: an error, or, if not strict, no change."""
    absent = F.raise_error(F.lit("Read header has no comment to put the sample barcode in")).cast("string") if strict else F.lit(None).cast("string")
    return h.withField("sample_barcode", F.when(h["has_comment"], barcode).otherwise(absent))


def set_umi(h: Column, umi: Column) -> Column:
    return h.withField("umi", umi)


def set_read_number(h: Column, number: Column) -> Column:
    absent = F.raise_error(F.lit("Read header has no comment to put the read number in")).cast("string")
    return h.withField("read_number", F.when(h["has_comment"], number.cast("string")).otherwise(absent))


def read_number(h: Column) -> Column:
    return h["read_number"]


def is_control(h: Column) -> Column:
    """There is a comment and its control number is not exactly 0."""
    return F.coalesce(h["control_number"] != "0", F.lit(False))


def is_failed_quality_filter(h: Column) -> Column:
    return F.coalesce(h["is_filtered"] == "Y", F.lit(False))


def read_name(head: Column) -> Column:
    return F.split_part(head, F.lit(" "), F.lit(1))


def header_barcode(h: Column) -> tuple[Column, Column]:
    """(concatenated, delimited) sample barcode of a header; only the first plus is taken out. No comment is an error."""
    told = F.when(h["has_comment"], h["sample_barcode"]).otherwise(F.raise_error(F.lit("Read header has no comment with a sample barcode")).cast("string"))
    return F.regexp_replace(told, r"^([^+]*)\+", "$1"), told
