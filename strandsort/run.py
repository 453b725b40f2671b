"""A run from options to files: inputs, plan, outputs and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsort.operators import metrics as R
from strandsort.options import Options, load_sheet
from strandsort.plans.demux import Demultiplexer, Rules
from strandsort.read_structure import output_kinds
from strandsort.samples import Sample
from strandsort.sources import commit, files, sink
from strandsort.sources.discovery import Group, resolve
from strandsort.sources.fastq import indexes, read_templates


@dataclass
class Prepared:
    options: Options
    samples: list[Sample]
    groups: list[Group]
    plan: Demultiplexer


def prepare(options: Options, groups: list[Group] | None = None) -> Prepared:
    """Everything that is checked before a read is looked at. Output types are those of the sheet's options, if it has some.

    The groups of input files are found by the options' paths where they are not given.
    """
    samples, options = load_sheet(options)
    if not files.is_folder(options.output_dir):
        raise ValueError(f"Output folder does not exist: {options.output_dir}")
    if groups is None:
        groups = resolve(options.fastqs, options.read_structures, options.sample_barcode_in_fastq_header, options.lane)
    thresholds = tuple(options.mask_thresholds(len(groups)))
    rules = Rules(
        options.allowed_mismatches, options.min_delta, options.free_ns, options.max_no_calls, options.filter_control_reads, options.filter_failing_quality,
        thresholds if any(thresholds) else (), options.override_matcher, options.strict_override, options.skip_read_name_check, options.sample_barcode_in_fastq_header,
    )
    plan = Demultiplexer(samples, [g.structure for g in groups], output_kinds(options.output_types), rules)
    return Prepared(options, samples, groups, plan)


def reports(spark: SparkSession, p: Prepared, assigned: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """Reports by file name, but for the run's totals. ``assigned`` has quality counts."""
    per_sample = R.with_all_samples(R.per_sample_counts(assigned), R.sample_table(spark, p.samples))
    columns = list(R.REPORT)
    found = {
        "per_sample_metrics.tsv": (R.report(per_sample).orderBy("ordinal"), columns),
        "per_project_metrics.tsv": (R.report(R.per_project_counts(per_sample, len(p.samples[0].barcode))).orderBy("_order"), columns),
    }
    if p.options.most_unmatched_to_output:
        found["most_frequent_unmatched.tsv"] = (R.most_frequent(R.unmatched_counts(assigned), p.options.most_unmatched_to_output), ["barcode", "count"])
    if p.plan.hop_lengths:
        hops = R.hop_counts(assigned, *p.plan.hop_lengths, p.samples)
        found["sample_barcode_hop_metrics.tsv"] = (hops.orderBy(F.desc("count"), "barcode"), ["barcode", "count"])
    return found


def stage(spark: SparkSession, p: Prepared, job: commit.Job, records_per_task: int, layout: str) -> tuple[dict[str, int], list[str], DataFrame]:
    """Write the outputs for a job to publish: records by file name, the names of all files, and the state from which reports are made."""
    groups, r = [g.files for g in p.groups], p.plan.rules
    marks = indexes(spark, groups, records_per_task)
    told = p.plan.with_drop_reason(p.plan.checked(read_templates(spark, groups, records_per_task, marks=marks)))
    # what is filtered does not leave the source; the state's pass checks and counts all templates
    asked = {"failed": r.filter_failing_quality, "control": r.filter_control_reads}
    passing = read_templates(spark, groups, records_per_task, tuple(k for k, v in asked.items() if v), marks)
    state = p.plan.counts(told, "drop_reason")
    names = sink.output_names(p.samples, p.plan.structures, p.plan.output_kinds)
    kept = p.plan.assign(passing)
    counts, written = sink.stage_outputs(p.plan.output_records(kept, ["file_idx", "rec_idx"]), names, job, layout=layout)
    return counts, written, state


def write_reports(spark: SparkSession, p: Prepared, job: commit.Job, state: DataFrame) -> list[str]:
    """Write all reports of a state for a job to publish; their names."""
    held, written = state.persist(StorageLevel.MEMORY_AND_DISK), []
    try:
        totals = R.run_counts(held)
        tables = {"metrics.tsv": (totals, totals.columns), **reports(spark, p, p.plan.matched(held.filter("drop_reason IS NULL")))}
        for name, (rows, columns) in tables.items():
            written.append(f"{p.options.metric_prefix or ''}{name}")
            sink.write_tsv(rows, columns, job.path(written[-1]))
    finally:
        held.unpersist()
    return written


def run(spark: SparkSession, options: Options, records_per_task: int = 1_000_000, layout: str = "files") -> dict[str, int]:
    """Demultiplex; records written by file name. Outputs and reports appear together when all are written, or not at all.

    The input is read once to count its lines, once for the outputs and once to sum up all templates by barcode and drop
    reason, from which totals and reports are made.
    """
    p = prepare(options)
    commit.recover(options.output_dir)
    with commit.Job(options.output_dir) as job:
        counts, written, state = stage(spark, p, job, records_per_task, layout)
        job.publish([*written, *write_reports(spark, p, job, state)])
    return counts
