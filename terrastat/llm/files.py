"""Files that tasks write to and read from the shared folder, on whatever store its URI names.

A file gets a name of its own with each attempt, and is named to others only by the rows that its
task returns. Spark commits those rows once, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def store(location: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a URI, or of a plain path."""
    if "://" in location or location.startswith("file:"):
        return fs.FileSystem.from_uri(location)
    return fs.LocalFileSystem(), location


def new_name(part: int, suffix: str) -> str:
    return f"part-{part:06d}-{uuid.uuid4().hex}.{suffix}"


def create(location: str, name: str) -> pa.NativeFile:
    where, path = store(location)
    where.create_dir(path, recursive=True)
    return where.open_output_stream(f"{path}/{name}", compression=None)


def open_mapped(location: str) -> pa.NativeFile:
    """For reading at any place: mapped into memory where the store is a local disk."""
    where, path = store(location)
    if isinstance(where, fs.LocalFileSystem):
        return pa.memory_map(path)
    return where.open_input_file(path)
