"""Binary files in the shared folder, whatever store holds it, by pyarrow's file systems."""

from __future__ import annotations

import re

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def create(path: str):
    """An output stream; missing folders are made. Readers only see files that a manifest table names, so an unfinished one is never read."""
    store, where = _at(path)
    store.create_dir(where.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(where)


def open_random(path: str):
    store, where = _at(path)
    return store.open_input_file(where)


def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    return file.read(length)


def remove(path: str) -> None:
    store, where = _at(path)
    store.delete_dir(where)
