"""Command line: ``python -m strandsort.cli --fastqs ... --sample-metadata ... --read-structures ... --output-dir ...``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from strandsort import version
from strandsort.options import parse_args
from strandsort.run import run


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv == ["--version"]:
        print(version())
        return 0
    try:
        options = parse_args(argv)
        run(SparkSession.builder.appName("strandsort").getOrCreate(), options)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
