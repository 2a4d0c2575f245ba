"""Binary files that tasks write to and read from the shared folder.

A task gives every file a new name and reports it in a row; the rows are committed by
Spark as a table. What a lost or repeated task leaves behind is in no such table and is
never read. Any store that ``pyarrow.fs`` reaches by URI can hold the folder.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write a new file whose name starts with ``name``; returns its path."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def read_file(path: str) -> pa.Buffer:
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as source:
        return source.read_buffer()
