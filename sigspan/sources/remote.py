"""Ranged reads from executors, on any file system Arrow knows.

Paths are plain local ones or ``scheme://authority/path`` with the path as it is
stored, not percent-encoded: the form that Spark lists. An encoded path is found,
too, where no file has the literal name.
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import unquote

import pyarrow.fs as pafs


@lru_cache(maxsize=64)
def _system(scheme: str, authority: str) -> tuple[pafs.FileSystem, str]:
    """Client of a store and the folder its paths start from; one per process."""
    # Spark and Arrow name the same object store differently.
    system, base = pafs.FileSystem.from_uri(f"{re.sub('^s3[an]$', 's3', scheme)}://{authority}/")
    return system, base.rstrip("/")


def _resolve(path: str) -> tuple[pafs.FileSystem, str, str, str]:
    """File system, path inside it, its first part there, and what stands for that part outside."""
    uri = re.match(r"^([a-z][a-z0-9+.-]*)://([^/]*)(/.*|$)", path)
    if uri is None or uri[1] == "file":
        system, base, outside = _LOCAL, "", ""
        rest = re.sub(r"^file:/+", "/", path)
    else:
        system, base = _system(uri[1], uri[2])
        outside, rest = f"{uri[1]}://{uri[2]}", uri[3]
    if "%" in rest and system.get_file_info(base + rest).type == pafs.FileType.NotFound:
        rest = unquote(rest)
    return system, base + rest, base, outside


_LOCAL = pafs.LocalFileSystem()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a path or URI names, and the path inside it."""
    system, inner, _, _ = _resolve(path)
    return system, inner


def open_file(path: str):
    """A seekable input file for a plain path or a URI."""
    system, inner, _, _ = _resolve(path)
    return system.open_input_file(inner)


def create_file(path: str):
    """An output stream for bytes as they are; missing folders are created."""
    system, inner, _, _ = _resolve(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def find_files(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of one file, or of every matching file below a folder."""
    system, inner, base, outside = _resolve(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(
        (outside + f.path.removeprefix(base), f.size) for f in found if f.is_file and f.path.endswith(ending)
    )
