"""Read structures such as ``8B100T`` or ``6M+T``: how a read is cut into typed segments."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

#: Template, sample barcode, molecular barcode (UMI), skip.
KINDS = "TBMS"
#: Order of groups of files by kind.
KIND_ORDER = "BMST"
#: Letter of a kind in file names and back.
FILE_LETTER = {"T": "R", "B": "I", "M": "U", "S": "S"}
KIND_OF_LETTER = {v: k for k, v in FILE_LETTER.items()}


@dataclass(frozen=True)
class Segment:
    """``length`` is None for what is left of the read."""

    kind: str
    offset: int
    length: int | None


@dataclass(frozen=True)
class ReadStructure:
    segments: tuple[Segment, ...]

    @classmethod
    def parse(cls, text: str) -> ReadStructure:
        text = text.strip().upper()
        found = re.findall(r"(\d+|\+)([A-Z])", text)
        if not found or "".join(n + k for n, k in found) != text:
            raise ValueError(f"Invalid read structure: {text!r}")
        segments, offset = [], 0
        for i, (n, kind) in enumerate(found):
            if kind not in KINDS:
                raise ValueError(f"Unknown segment kind {kind!r} in read structure {text!r}")
            if n == "+" and i < len(found) - 1:
                raise ValueError(f"Only the last segment may have no length: {text!r}")
            length = None if n == "+" else int(n)
            if length == 0:
                raise ValueError(f"Segment of length zero in read structure {text!r}")
            segments.append(Segment(kind, offset, length))
            offset += length or 0
        return cls(tuple(segments))

    def __str__(self) -> str:
        return "".join(f"{'+' if s.length is None else s.length}{s.kind}" for s in self.segments)

    def of_kind(self, kind: str) -> tuple[Segment, ...]:
        return tuple(s for s in self.segments if s.kind == kind)

    @property
    def kinds(self) -> list[str]:
        """Distinct kinds in the order of their letters."""
        return sorted({s.kind for s in self.segments})

    @property
    def fixed_length(self) -> int:
        return sum(s.length or 0 for s in self.segments)

    @property
    def barcode_length(self) -> int:
        if any(s.length is None for s in self.of_kind("B")):
            raise ValueError(f"Sample barcode segment must have a length: {self}")
        return sum(s.length for s in self.of_kind("B"))

    def with_fixed_barcodes(self, read_length: int) -> ReadStructure:
        """Give a sample barcode segment without length, and with it all such segments, what the read leaves."""
        if all(s.length is not None for s in self.of_kind("B")):
            return self
        rest = read_length - self.fixed_length
        if rest <= 0:
            raise ValueError(f"Read of length {read_length} leaves no bases for the last segment of {self}")
        return ReadStructure(tuple(replace(s, length=rest) if s.length is None else s for s in self.segments))


def output_kinds(text: str) -> list[str]:
    """Kinds to write, from a string such as ``TB``."""
    for c in text:
        if c not in KINDS:
            raise ValueError(f"Unknown output type: {c!r}")
    return list(dict.fromkeys(text))


def outputs(structures: list[ReadStructure], kinds: list[str]) -> list[tuple[int, str, int]]:
    """(structure, kind, number) of each output: one for each structure and distinct kind, numbered by kind."""
    numbers: dict[str, int] = {}
    found = []
    for i, s in enumerate(structures):
        for kind in s.kinds:
            if kind in kinds:
                numbers[kind] = numbers.get(kind, 0) + 1
                found.append((i, kind, numbers[kind]))
    return found
