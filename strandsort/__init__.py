"""Spark-native demultiplexing of sequencing reads, with metrics and reports."""

from __future__ import annotations

import subprocess
from pathlib import Path

__version__ = "0.2.0"


def version() -> str:
    """The version, with the revision and whether it has changes where this is run from a checkout."""
    try:
        told = subprocess.run(["git", "describe", "--always", "--dirty", "--abbrev=12"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.SubprocessError):
        return __version__
    return f"{__version__}-{told.stdout.strip()}" if told.returncode == 0 else __version__
