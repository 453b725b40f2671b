"""Input files: explicit paths with read structures, or prefixes whose files are grouped by kind."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from strandsort.read_structure import KIND_OF_LETTER, KIND_ORDER, ReadStructure
from strandsort.sources import files
from strandsort.sources.fastq import first_record

NAME = re.compile(r"(.*)_L00(\d)_([RIUS])(\d)_001\.fastq\.gz")


@dataclass(frozen=True)
class InputFile:
    path: str
    prefix: str
    lane: int
    kind: str
    number: int


@dataclass
class Group:
    files: list[str]
    structure: ReadStructure


def find(path: str) -> list[InputFile]:
    """Files in a folder, or beside a prefix, that are named like sequencer output."""
    folder, prefix = (path.rstrip("/"), "") if files.is_folder(path) else (path.rpartition("/")[0] or ("/" if path.startswith("/") else "."), path.rpartition("/")[2])
    named = [(name, NAME.fullmatch(name)) for name in files.names_in(folder) if name.startswith(prefix)]
    return [InputFile(f"{folder.rstrip('/')}/{name}", m[1], int(m[2]), KIND_OF_LETTER[m[3]], int(m[4])) for name, m in named if m]


def from_prefixes(paths: list[str], lanes: list[int]) -> list[Group]:
    found = [f for p in paths for f in find(p) if not lanes or f.lane in lanes]
    groups: dict[tuple[int, int], list[InputFile]] = {}
    for f in found:
        groups.setdefault((KIND_ORDER.index(f.kind), f.number), []).append(f)
    return [Group([f.path for f in sorted(g, key=lambda f: (f.prefix, f.lane))], ReadStructure.parse(f"+{KIND_ORDER[k]}")) for (k, _), g in sorted(groups.items())]


def resolve(fastqs: list[str], structures: list[ReadStructure], barcode_in_header: bool, lanes: list[int]) -> list[Group]:
    """Groups of files with their read structures, checked: sizes, first names, barcode lengths."""
    are_files = [files.is_file(p) for p in fastqs]
    if not fastqs:
        raise ValueError("Give at least one FASTQ or path prefix")
    if all(are_files):
        if lanes:
            raise ValueError("Lanes can be chosen with path prefixes only")
        if len(structures) != len(fastqs):
            raise ValueError(f"{len(fastqs)} FASTQs and {len(structures)} read structures were given")
        if barcode_in_header and any(s.of_kind("B") for s in structures):
            raise ValueError("Sample barcode segments can't be given when the barcode is in the header")
        groups = [Group([p], s) for p, s in zip(fastqs, structures, strict=True)]
    elif any(are_files):
        raise ValueError("Give either files or path prefixes, not both")
    else:
        groups = from_prefixes(fastqs, lanes)
        if not groups:
            raise ValueError(f"No FASTQs found for: {', '.join(fastqs)}")
        if barcode_in_header and any(g.structure.of_kind("B") for g in groups):
            raise ValueError("Index files can't be given when the barcode is in the header")
        if structures:
            if len(structures) != len(groups):
                raise ValueError(f"{len(groups)} groups of FASTQs and {len(structures)} read structures were given")
            groups = [Group(g.files, s) for g, s in zip(groups, structures, strict=True)]
    return checked(groups)


def checked(groups: list[Group]) -> list[Group]:
    """Groups of as many files each, whose first reads have one name; variable barcodes get the length that the first read leaves them."""
    if len({len(g.files) for g in groups}) != 1:
        raise ValueError("All groups of FASTQs must have the same number of files")
    paths = [p for g in groups for p in g.files]
    with ThreadPoolExecutor(16) as pool:  # a block of each file, waiting for the store most of the time
        firsts = dict(zip(paths, pool.map(first_record, paths), strict=True))
    if len({head.split(":")[0] for head, _, _ in firsts.values()}) > 1:
        raise ValueError("First reads' names differ between FASTQs")
    return [Group(g.files, g.structure.with_fixed_barcodes(len(firsts[g.files[0]][1]))) for g in groups]
