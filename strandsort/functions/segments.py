"""Segments of reads as column expressions: cut, join, mask and count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandsort.read_structure import ReadStructure, Segment


#: The quality of the last printable character.
HIGHEST = 93


@dataclass(frozen=True)
class Read:
    """Columns of one read of a template."""

    head: Column
    seq: Column
    qual: Column


def cut_segment(text: Column, segment: Segment, name: Column | None = None) -> Column:
    """The segment's characters. A read that ends before the segment does is an error."""
    end = segment.offset + (1 if segment.length is None else segment.length)
    found = F.substring(text, segment.offset + 1, 2**31 - 1 if segment.length is None else segment.length)
    if name is None:
        return found
    short = F.raise_error(F.concat(F.lit("Read too short for its structure: "), name)).cast("string")
    return F.when(F.length(text) >= end, found).otherwise(short)


def joined(read: Read, structure: ReadStructure, kind: str, part: str = "seq") -> Column:
    """Bases (seq) or qualities (qual) of all segments of a kind, one after another."""
    return F.concat(*[cut_segment(getattr(read, part), s, read.head) for s in structure.of_kind(kind)] or [F.lit("")])


def barcode(reads: list[Read], structures: list[ReadStructure], kind: str) -> tuple[Column, Column]:
    """(concatenated, plus-delimited) segments of a kind over all reads of a template."""
    cut = [cut_segment(r.seq, s, r.head) for r, t in zip(reads, structures, strict=True) for s in t.of_kind(kind)]
    if not cut:
        return F.lit(""), F.lit("")
    return F.concat(*cut), F.concat_ws("+", *cut)


def mask(seq: Column, qual: Column, threshold: int) -> Column:
    """N for every base whose quality is below the threshold.

    All qualities from the threshold on become one character; runs between them are masked as a whole, so that a read
    without low qualities costs one pattern match and no work per base.
    """
    if threshold <= 0:
        return seq
    threshold = min(threshold, HIGHEST + 1)
    low = f"[\\x00-\\x{33 + threshold - 1:02x}]"
    per_base = F.array_join(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))), lambda i: F.when(F.ascii(F.substring(qual, i, F.lit(1))) - 33 < threshold, F.lit("N")).otherwise(F.substring(seq, i, F.lit(1)))),
        "",
    )
    return F.when(qual.rlike(low), per_base).otherwise(seq)


def n_calls(bases: Column) -> Column:
    """How many bases are N."""
    return F.length(bases) - F.length(F.translate(bases, "N", ""))


def _checked(qual: Column, value: Column) -> Column:
    """The value; a quality character below 33 is an error."""
    return F.when(qual.rlike("[\\x00-\\x20]"), F.raise_error(F.concat(F.lit("Quality below 33 in: "), qual)).cast("long")).otherwise(value)


def _at_least(qual: Column, q: int) -> Column:
    return _checked(qual, F.length(F.regexp_replace(qual, f"[^\\x{33 + q:02x}-\\x7e]+", "")).cast("long"))


def q30_bases(qual: Column) -> Column:
    return _at_least(qual, 30)


def q20_bases(qual: Column) -> Column:
    return _at_least(qual, 20)


def quality_sum(qual: Column, length: int | None = None) -> Column:
    """Sum of the qualities. Where their number is known, as in sample barcodes, it is generated code, a term for each."""
    if length is not None and length <= 64:
        terms = [F.ascii(F.substring(qual, i, 1)) for i in range(1, length + 1)]
        return _checked(qual, (sum(terms[1:], terms[0]) - 33 * F.length(qual)).cast("long")) if terms else F.lit(0).cast("long")
    codes = F.transform(F.split(qual, ""), lambda c: (F.ascii(c) - 33).cast("long"))
    return _checked(qual, F.aggregate(F.filter(codes, lambda c: c > -33), F.lit(0).cast("long"), lambda a, c: a + c))
