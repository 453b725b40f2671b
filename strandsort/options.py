"""Options of a run, and the command line that gives them."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields
from pathlib import Path

from strandsort import samples as S
from strandsort.operators.matching import MatcherKind
from strandsort.read_structure import ReadStructure


@dataclass
class Options:
    fastqs: list[str] = field(default_factory=list)
    sample_metadata: str = ""
    read_structures: list[ReadStructure] = field(default_factory=list)
    output_dir: str = ""
    allowed_mismatches: int = 1
    min_delta: int = 2
    free_ns: int = 1
    max_no_calls: int | None = None
    quality_mask_threshold: list[int] = field(default_factory=list)
    filter_control_reads: bool = False
    filter_failing_quality: bool = False
    output_types: str = "T"
    undetermined_sample_name: str = S.UNDETERMINED
    most_unmatched_to_output: int = 1000
    #: The next ones size threads, channels and maps of a single process; Spark's own settings take their place.
    most_unmatched_channel_size: int = 1000
    most_unmatched_max_map_size: int = 5_000_000
    most_unmatched_downsize_to: int = 5_000
    chunksize: int = 1000
    demux_threads: int = 4
    compressor_threads: int = 12
    writer_threads: int = 5
    decompression_threads_per_reader: int = 4
    override_matcher: MatcherKind | None = None
    #: The override also counts where it asks for the cached rule and barcodes are short.
    strict_override: bool = False
    skip_read_name_check: bool = False
    sample_barcode_in_fastq_header: bool = False
    metric_prefix: str | None = None
    lane: list[int] = field(default_factory=list)

    def mask_thresholds(self, n: int) -> list[int]:
        """One for each FASTQ, from none, one or n values."""
        given = self.quality_mask_threshold
        if len(given) not in (0, 1, n):
            raise ValueError(f"Give no quality mask threshold, one, or one for each of the {n} FASTQs; got {len(given)}")
        return list(given) if len(given) == n and n else (given or [0]) * n


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


SHORT = {"fastqs": "f", "sample_metadata": "s", "read_structures": "r", "output_dir": "o", "allowed_mismatches": "m", "min_delta": "d", "free_ns": "F", "max_no_calls": "N", "quality_mask_threshold": "M", "filter_control_reads": "C", "filter_failing_quality": "Q", "output_types": "T", "undetermined_sample_name": "u", "most_unmatched_to_output": "U", "chunksize": "c", "demux_threads": "t", "lane": "l"}
NUMBER = {"allowed_mismatches", "min_delta", "free_ns", "max_no_calls", "most_unmatched_to_output", "most_unmatched_channel_size", "most_unmatched_max_map_size", "most_unmatched_downsize_to", "chunksize", "demux_threads", "compressor_threads", "writer_threads", "decompression_threads_per_reader", "quality_mask_threshold", "lane"}


def _whole(text: str) -> int:
    if int(text) < 0:
        raise ValueError(text)
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="strandsort", description="Demultiplex block-gzipped FASTQ files by sample barcode.")
    for f in fields(Options):
        names = [*([f"-{SHORT[f.name]}"] if f.name in SHORT else []), f"--{f.name.replace('_', '-')}"]
        default = Options.__dataclass_fields__[f.name]
        if default.type == "bool":
            p.add_argument(*names, dest=f.name, action="store_true", default=None)
            continue
        kind = _whole if f.name in NUMBER else ReadStructure.parse if f.name == "read_structures" else MatcherKind.parse if f.name == "override_matcher" else str
        p.add_argument(*names, dest=f.name, type=kind, default=None, **({"nargs": "+"} if str(default.type).startswith("list") else {}))
    return p


def parse_args(argv: list[str], base: Options | None = None) -> Options:
    """Options of a command line, over those of ``base``."""
    given = vars(parser().parse_args(argv))
    out = Options(**{f.name: getattr(base, f.name) for f in fields(Options)}) if base else Options()
    for k, v in given.items():
        if v is not None:
            setattr(out, k, v)
    return out


def load_sheet(options: Options) -> tuple[list[S.Sample], Options]:
    """Samples, checked and with the undetermined one, and the options with those of the sheet's [Demux] section over them."""
    text = Path(options.sample_metadata).read_text()
    if not text.strip():
        raise S.EmptySheet("There is nothing in the sample sheet")
    if any(line.startswith(("[Demux]", "[Data]")) for line in text.splitlines()):
        rows = S.records(text, trim=True)
        if (demux := S.find_section(rows, "[Demux]")) is not None:
            args = S.demux_arguments(rows[slice(*demux)])
            try:
                options = parse_args(args, options)
            except (ValueError, argparse.ArgumentError) as e:
                raise S.DemuxOptionsError(f"[Demux] has options that can't be read ({e}): {' '.join(args)}") from e
        data = S.find_section(rows, "[Data]")
        if data is None:
            raise S.NoData("The sheet has no [Data] section with samples")
        found = S.read_data_rows(rows[slice(*data)], data[0] + 1)
    else:
        found = S.parse_simple(text)
    found = S.coalesce(found, options.lane)
    return S.validate(found, options.allowed_mismatches, options.min_delta, options.undetermined_sample_name, options.lane), options
