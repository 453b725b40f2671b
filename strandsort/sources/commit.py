"""All files of a run appear together, or none does.

A run writes under ``<folder>/.run-<id>``, where nothing has its final name. ``publish`` first writes a journal of the
files and their sizes there, under another name, then renames it: this is the moment at which the run is committed. Then
each file is moved to its final name, and the run's own folder is removed. Whoever finds a journal can finish what it
says: moves that are done are passed over, so that ``recover`` may run any number of times. A run without a journal has
published nothing; its folder can be removed.
"""

from __future__ import annotations

import json
import uuid
from types import TracebackType

from strandsort.sources import files

PREFIX = ".run-"
JOURNAL = "journal.json"


class Job:
    """``with Job(folder) as job``: write to ``job.path(name)``, then ``job.publish(names)``; on an error nothing stays."""

    def __init__(self, folder: str):
        self.folder = folder
        self.stage = f"{folder}/{PREFIX}{uuid.uuid4().hex}"
        files.make_folder(self.stage)
        self.committed = False

    def path(self, name: str) -> str:
        """Where to write what will be ``name`` in the run's folder."""
        path = f"{self.stage}/final/{name}"
        files.make_folder(path.rpartition("/")[0])
        return path

    def publish(self, names: list[str]) -> None:
        sizes = {name: files.size(f"{self.stage}/final/{name}") for name in names}
        missing = [name for name in names if not files.is_file(f"{self.stage}/final/{name}")]
        if missing:
            raise FileNotFoundError(f"Not written: {', '.join(missing)}")
        files.write_whole(f"{self.stage}/{JOURNAL}", json.dumps(sizes).encode())
        self.committed = True
        finish(self.folder, self.stage)

    def __enter__(self) -> Job:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if not self.committed:
            files.remove_folder(self.stage)


def finish(folder: str, stage: str) -> None:
    """Do what a journal says, and what was not done of it."""
    with files.reading(f"{stage}/{JOURNAL}") as f:
        sizes = json.loads(f.read())
    for parent in {f"{folder}/{name}".rpartition("/")[0] for name in sizes}:
        files.make_folder(parent)
    for name, size in sizes.items():
        staged, target = f"{stage}/final/{name}", f"{folder}/{name}"
        if files.is_file(staged):
            files.move(staged, target)
        elif not files.is_file(target) or files.size(target) != size:
            raise FileNotFoundError(f"{target} is neither staged nor there with {size} bytes")
    files.remove_folder(stage)


def recover(folder: str, sweep: bool = False) -> list[str]:
    """Finish the committed runs whose driver ended early; their folders. ``sweep`` also removes what uncommitted runs left,
    and is for when no run is at work in the folder."""
    found = []
    for name in files.folders_in(folder):
        stage = f"{folder}/{name}"
        if not name.startswith(PREFIX):
            continue
        if files.is_file(f"{stage}/{JOURNAL}"):
            finish(folder, stage)
            found.append(stage)
        elif sweep:
            files.remove_folder(stage)
    return found
