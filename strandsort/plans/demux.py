"""The plan of a run: from templates (one column group per FASTQ) to assigned templates and output records.

Everything here compiles to projections and filters of one scan: drop reasons, barcodes, the match, quality counts and
output records are columns of the templates, and only reports and sinks shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandsort.functions import header as H
from strandsort.functions import segments as G
from strandsort.operators.matching import Matcher, MatcherKind, choose, with_match
from strandsort.operators.metrics import QUALITY
from strandsort.read_structure import ReadStructure, outputs
from strandsort.samples import Sample, is_bypass


@dataclass(frozen=True)
class Rules:
    allowed_mismatches: int = 1
    min_delta: int = 2
    free_ns: int = 1
    max_no_calls: int | None = None
    filter_control_reads: bool = False
    filter_failing_quality: bool = False
    mask_thresholds: tuple[int, ...] = ()
    matcher: MatcherKind | Matcher | None = None
    strict_override: bool = False
    skip_read_name_check: bool = False
    barcode_in_header: bool = False


def summed(counts: DataFrame, *keys: str) -> DataFrame:
    """Rows with n_reads and quality counts, added up by barcode (and keys)."""
    return counts.groupBy(*keys, "bc", "bc_delim").agg(*[F.sum(q).alias(q) for q in ("n_reads", *QUALITY)])


@dataclass
class Demultiplexer:
    """Templates have columns head_<i>, seq_<i>, qual_<i> for each FASTQ i, and keep all their other columns."""

    samples: list[Sample]
    structures: list[ReadStructure]
    output_kinds: list[str] = field(default_factory=lambda: ["T"])
    rules: Rules = Rules()

    def __post_init__(self) -> None:
        if not self.structures:
            raise ValueError("At least one read structure is needed")
        if not any(s.of_kind("T") for s in self.structures):
            raise ValueError("At least one read structure must have a template segment")
        if not (is_bypass(self.samples) or self.rules.barcode_in_header or any(s.of_kind("B") for s in self.structures)):
            raise ValueError("At least one read structure must have a sample barcode segment")
        if self.rules.barcode_in_header and any(s.of_kind("B") for s in self.structures):
            raise ValueError("Sample barcode segments can't be given when the barcode is in the header")
        if len({len(s.barcode) for s in self.samples}) != 1:
            raise ValueError("Sample barcodes must have the same length")
        length = sum(s.barcode_length for s in self.structures)
        if not is_bypass(self.samples) and not self.rules.barcode_in_header and length != len(self.samples[0].barcode):
            raise ValueError(f"The read structures' sample barcodes have {length} bases, the samples' {len(self.samples[0].barcode)}")
        if self.rules.mask_thresholds and len(self.rules.mask_thresholds) != len(self.structures):
            raise ValueError("Quality mask thresholds and read structures differ in number")
        if not self.outputs:
            raise ValueError("No segment is of an output type: nothing would be written")

    @property
    def outputs(self) -> list[tuple[int, str, int]]:
        return outputs(self.structures, self.output_kinds)

    @property
    def undetermined(self) -> int:
        return len(self.samples) - 1

    @property
    def hop_lengths(self) -> tuple[int, int] | None:
        """Lengths of the two barcode parts if exactly two structures have some."""
        have = [s.barcode_length for s in self.structures if s.of_kind("B")]
        return (have[0], have[1]) if len(have) == 2 and not is_bypass(self.samples) else None

    def reads(self) -> list[G.Read]:
        return [G.Read(F.col(f"head_{i}"), F.col(f"seq_{i}"), F.col(f"qual_{i}")) for i in range(len(self.structures))]

    def checked(self, templates: DataFrame) -> DataFrame:
        """Fail where the reads of a template have different names."""
        if self.rules.skip_read_name_check or len(self.structures) == 1:
            return templates
        first, *rest = [H.read_name(r.head) for r in self.reads()]
        same = [n.eqNullSafe(first) for n in rest]
        wrong = F.raise_error(F.concat_ws(" ", F.lit("Read names differ:"), first, *rest)).cast("boolean")
        # a filter, as a column that nobody asks for would not be computed
        return templates.filter(F.when(reduce(Column.__and__, same), F.lit(True)).otherwise(wrong))

    def with_drop_reason(self, templates: DataFrame) -> DataFrame:
        """Reads in their order, in each quality before control; the first that applies is the reason."""
        found = []
        for r in self.reads():
            h = H.parse_header(r.head)
            if self.rules.filter_failing_quality:
                found.append(F.when(H.is_failed_quality_filter(h), F.lit("quality")))
            if self.rules.filter_control_reads:
                found.append(F.when(H.is_control(h), F.lit("control")))
        return templates.withColumn("drop_reason", F.coalesce(*found) if found else F.lit(None).cast("string"))

    def with_barcodes(self, templates: DataFrame) -> DataFrame:
        """Add bc, bc_delim, umi_delim."""
        reads = self.reads()
        if self.rules.barcode_in_header:
            bc, delim = H.header_barcode(H.parse_header(reads[0].head))
        else:
            bc, delim = G.barcode(reads, self.structures, "B")
        return templates.withColumns({"bc": bc, "bc_delim": delim, "umi_delim": G.barcode(reads, self.structures, "M")[1]})

    def matcher(self) -> MatcherKind | Matcher:
        if self.rules.matcher is not None and not isinstance(self.rules.matcher, MatcherKind):
            return self.rules.matcher
        return choose(len(self.samples[0].barcode), self.rules.matcher, self.rules.strict_override)

    def assign(self, templates: DataFrame) -> DataFrame:
        """Templates that stay, with bc, bc_delim, umi_delim, sample_ordinal, matched and hamming_dist."""
        return self.assign_all(self.with_drop_reason(self.checked(templates)).filter("drop_reason IS NULL").drop("drop_reason"))

    def assign_all(self, templates: DataFrame) -> DataFrame:
        """assign() for templates that are checked already, none of which is left out."""
        return self.matched(self.with_barcodes(templates))

    def matched(self, barcoded: DataFrame) -> DataFrame:
        if is_bypass(self.samples):
            return barcoded.withColumns({"sample_ordinal": F.lit(0), "hamming_dist": F.lit(None).cast("int"), "matched": F.lit(False)})
        r = self.rules
        expected = [s.barcode for s in self.samples[:-1]]
        found = with_match(barcoded, "bc", expected, self.matcher(), r.allowed_mismatches, r.min_delta, r.free_ns, r.max_no_calls)
        return found.withColumns({"matched": F.col("sample_ordinal").isNotNull(), "sample_ordinal": F.coalesce("sample_ordinal", F.lit(self.undetermined))})

    def counts(self, templates: DataFrame, *keys: str) -> DataFrame:
        """Checked templates summed up by barcode (and keys): n_reads and quality counts. Such counts can be kept and summed up again."""
        return summed(self.with_quality(self.with_barcodes(templates)).withColumn("n_reads", F.lit(1).cast("long")), *keys)

    def by_barcode(self, templates: DataFrame, *keys: str) -> DataFrame:
        """What reports are made of: counts() with each barcode's match."""
        return self.matched(self.counts(templates, *keys))

    def report_rows(self, templates: DataFrame) -> DataFrame:
        """by_barcode() of the templates that stay."""
        return self.by_barcode(self.with_drop_reason(self.checked(templates)).filter("drop_reason IS NULL"))

    def with_quality(self, assigned: DataFrame) -> DataFrame:
        """Add the quality counts, of unmasked qualities, whatever is written."""
        reads = list(zip(self.reads(), self.structures, strict=True))
        over = lambda kind: [(G.joined(r, s, kind, "qual"), s) for r, s in reads if s.of_kind(kind)]
        total = lambda cols: sum(cols[1:], cols[0]) if cols else F.lit(0).cast("long")
        template, index = [q for q, _ in over("T")], over("B")
        values = (
            total([G.q20_bases(q) for q in template]),
            total([G.q30_bases(q) for q in template]),
            total([F.length(q).cast("long") for q in template]),
            total([G.quality_sum(q, s.barcode_length) for q, s in index]),
            total([F.length(q).cast("long") for q, _ in index]),
        )
        return assigned.withColumns(dict(zip(QUALITY, values, strict=True)))

    def with_headers(self, templates: DataFrame) -> DataFrame:
        """Add _h_<i>, the parsed header of each read: parsed once, however many outputs are written."""
        return templates.withColumns({f"_h_{i}": H.parse_header(r.head) for i, r in enumerate(self.reads())})

    def record(self, i: int, kind: str) -> tuple[Column, Column, Column]:
        """(head, seq, qual) of the output of structure i and a kind, for templates with headers."""
        read, structure, h = self.reads()[i], self.structures[i], F.col(f"_h_{i}")
        seq, qual = G.joined(read, structure, kind), G.joined(read, structure, kind, "qual")
        if kind == "T" and self.rules.mask_thresholds:
            seq = G.mask(seq, qual, self.rules.mask_thresholds[i])
        given = lambda new, old: F.when(new != "", new).otherwise(old)
        # a header without comment has no place for the barcode and stays without it
        parts = {f: h[f] for f in (*H.NAME_FIELDS, "umi", "has_comment", *H.INFO_FIELDS, "other")}
        parts["umi"] = given(F.col("umi_delim"), h["umi"])
        parts["sample_barcode"] = given(F.col("bc_delim"), h["sample_barcode"])
        return H.format_header(parts), seq, qual

    def output_records(self, assigned: DataFrame, keep: list[str]) -> DataFrame:
        """(sample_ordinal, output, head, seq, qual) and the columns to keep, a row for each output of each template."""
        numbers = F.array(*[F.lit(k) for k in range(len(self.outputs))])
        # columns that nobody asks for are not computed, and of the others only those of the row's own output
        rows = self.with_headers(assigned).withColumn("output", F.explode(numbers))
        parts = [self.record(i, kind) for i, kind, _ in self.outputs]
        of = lambda n: F.coalesce(*[F.when(F.col("output") == k, p[n]) for k, p in enumerate(parts)])
        return rows.select("sample_ordinal", *keep, "output", of(0).alias("head"), of(1).alias("seq"), of(2).alias("qual"))


def zip_reads(reads: list[DataFrame], keys: list[str]) -> DataFrame:
    """Join reads (keys, head, seq, qual) of several FASTQs by position; a read without its mates is an error.

    All rows that are read are checked. A later filter that no row without a mate can pass leaves those out before.
    """
    joined = reads[0].select(*keys, *[F.col(c).alias(f"{c}_0") for c in ("head", "seq", "qual")])
    for i, r in enumerate(reads[1:], 1):
        joined = joined.join(r.select(*keys, *[F.col(c).alias(f"{c}_{i}") for c in ("head", "seq", "qual")]), keys, "full_outer")
    if len(reads) == 1:
        return joined
    all_there = reduce(Column.__and__, [F.col(f"head_{i}").isNotNull() for i in range(len(reads))])
    uneven = F.raise_error(F.lit("FASTQs have different numbers of records")).cast("boolean")
    return joined.filter(F.when(all_there, F.lit(True)).otherwise(uneven))
