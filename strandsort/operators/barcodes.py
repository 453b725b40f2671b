"""What matchers share: the rules' names, and barcodes as one-hot bits."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases in a long, four bits each.
WORD = 15
#: Barcodes up to this length are matched by the precompute rule.
PRECOMPUTE_LENGTH = 12


class MatcherKind(Enum):
    CACHED = "cached-hamming-distance"
    PRECOMPUTE = "pre-compute"

    @classmethod
    def parse(cls, text: str) -> MatcherKind:
        for kind in cls:
            if kind.value == text.lower():
                return kind
        raise ValueError(f"Unknown matcher: {text!r}")


def choose(length: int, override: MatcherKind | None = None, strict: bool = False) -> MatcherKind:
    """By barcode length; an override to the cached rule counts for short barcodes only if strict."""
    if override is not None and (strict or override is MatcherKind.PRECOMPUTE):
        return override
    return MatcherKind.PRECOMPUTE if length <= PRECOMPUTE_LENGTH else MatcherKind.CACHED


def hot(text: str) -> list[int]:
    bits = {"A": 1, "C": 2, "G": 4, "T": 8}
    words = [text[i : i + WORD] for i in range(0, len(text), WORD)]
    return [int("".join(f"{bits.get(c, 0):x}" for c in w.ljust(WORD, "N")), 16) for w in words]


def one_hot(barcode: Column, length: int) -> list[Column]:
    """The barcode's words of 15 bases, up to ``length`` bases."""
    digits = F.translate(F.regexp_replace(barcode, "[^ACGT]", "N"), "ACGTN", "12480")
    padded = F.rpad(digits, -(-length // WORD) * WORD, "0")
    return [F.conv(F.substring(padded, i + 1, WORD), 16, 10).cast("long") for i in range(0, length, WORD)]
