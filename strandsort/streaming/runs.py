"""Templates that arrive as files: the batch plan on a stream, with running counts per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandsort.operators.metrics import per_sample_counts
from strandsort.plans.demux import Demultiplexer


def running_counts(templates: DataFrame, plan: Demultiplexer) -> DataFrame:
    """Per-sample counts of a stream of templates; write in complete or update mode. State is one row a sample."""
    return per_sample_counts(plan.with_quality(plan.assign(templates)))
