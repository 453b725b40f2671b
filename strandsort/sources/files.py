"""Files by path or URI: a mounted file system, or any store that Arrow's file systems open (s3, gs, hdfs)."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and "://" not in path:  # as Hadoop writes it
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def info(path: str) -> fs.FileInfo:
    system, inside = at(path)
    return system.get_file_info(inside)


def is_file(path: str) -> bool:
    return info(path).type == fs.FileType.File


def is_folder(path: str) -> bool:
    return info(path).type == fs.FileType.Directory


def size(path: str) -> int:
    return info(path).size or 0


def names_in(folder: str) -> list[str]:
    """The names of the files in a folder, in order."""
    system, inside = at(folder)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inside)) if x.type == fs.FileType.File)


def folders_in(folder: str) -> list[str]:
    system, inside = at(folder)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(inside)) if x.type == fs.FileType.Directory)


def local_path(path: str) -> str | None:
    """The path on a mounted file system, if it is on one: there a file can be written at any place."""
    system, inside = at(path)
    return inside if isinstance(system, fs.LocalFileSystem) else None


def reading(path: str) -> pa.NativeFile:
    system, inside = at(path)
    return system.open_input_file(inside)


def writing(path: str) -> pa.NativeFile:
    system, inside = at(path)
    return system.open_output_stream(inside)


def write_whole(path: str, data: bytes) -> None:
    """Write under another name, then rename, so that the path never holds half a file."""
    attempt = f"{path}.{uuid.uuid4().hex}"
    with writing(attempt) as out:
        out.write(data)
    move(attempt, path)


def make_folder(path: str) -> None:
    system, inside = at(path)
    system.create_dir(inside, recursive=True)


def remove_folder(path: str) -> None:
    system, inside = at(path)
    system.delete_dir(inside)


def move(old: str, new: str) -> None:
    system, inside = at(old)
    system.move(inside, at(new)[1])
