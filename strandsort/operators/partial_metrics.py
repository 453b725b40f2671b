"""Metrics of lanes that arrive one after another: partial states, kept as a table and merged without the reads.

A state has a row for each drop reason and barcode of a lane, with how many templates it stands for and their quality
counts. These add up, and a barcode's match depends on nothing else, so that all reports of a run can be made from the
states of its lanes, under any matching rules, and lanes may be added or replaced. A state is written under a name of its
own, and then made the lane's by renaming a small pointer file: readers see a lane's old state or its new one, whole, and
whoever writes a lane again, after a failure or with new reads, does not count it twice.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession

from strandsort.operators.metrics import QUALITY
from strandsort.plans.demux import Demultiplexer, summed
from strandsort.sources import files

SCHEMA = "drop_reason string, bc string, bc_delim string, n_reads long, " + ", ".join(f"{q} long" for q in QUALITY)


def state_of(plan: Demultiplexer, templates: DataFrame) -> DataFrame:
    """The state of some templates, which are checked, and counted by drop reason."""
    return plan.counts(plan.with_drop_reason(plan.checked(templates)), "drop_reason")


def file_name(lane: str) -> str:
    return quote(lane, safe="").replace(".", "%2E")


def save(state: DataFrame, folder: str, lane: str) -> None:
    """Make a state the lane's; the one before, if there is one, is forgotten."""
    path = f"{folder}/states/{uuid.uuid4().hex}"
    state.write.parquet(path)
    files.make_folder(f"{folder}/lanes")
    files.write_whole(f"{folder}/lanes/{file_name(lane)}", json.dumps({"state": path}).encode())


def lanes(folder: str) -> dict[str, str]:
    """The path of each lane's state."""
    found = {}
    for name in files.names_in(f"{folder}/lanes") if files.is_folder(f"{folder}/lanes") else ():
        if "." not in name:  # else it is being written
            with files.reading(f"{folder}/lanes/{name}") as f:
                found[unquote(name)] = json.loads(f.read())["state"]
    return found


def merged(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """The sum of all lanes' states, or of those that are named."""
    found = lanes(folder)
    paths = [found[x] for x in (sorted(found) if only is None else only)]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return summed(reduce(DataFrame.unionByName, [spark.read.schema(SCHEMA).parquet(p) for p in paths]), "drop_reason")


def report_rows(plan: Demultiplexer, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What metrics.run_counts() takes, and what the other reports take, from a merged state."""
    return state.select("drop_reason", "n_reads"), plan.matched(state.filter("drop_reason IS NULL"))
