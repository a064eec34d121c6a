"""Files on local or shared storage for the Python data sources: a path may be
local or a URI that Arrow's file systems know (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import fnmatch
import io
import os

from pyarrow import fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def list_files(path: str, suffix: str) -> list[str]:
    """The path itself, the files with the suffix in it if it is a folder, or
    those that a pattern in its last part matches; in order of name."""
    system, at = resolve(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    folder, pattern = (at, f"*{suffix}") if info.type == pafs.FileType.Directory else os.path.split(at)
    found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    out = sorted(prefix + f.path for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))
    if not out:
        raise FileNotFoundError(path)
    return out


def open_file(path: str) -> io.BufferedReader:
    """A file for reading at any position."""
    system, at = resolve(path)
    return io.BufferedReader(system.open_input_file(at), 1 << 16)


def create_file(path: str):
    """A new file for writing; its folder is made if need be."""
    system, at = resolve(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    return system.open_output_stream(at)


def move(source: str, target: str) -> None:
    system, at = resolve(source)
    system.move(at, resolve(target)[1])


def remove(path: str) -> None:
    system, at = resolve(path)
    system.delete_file(at)
