"""Byte access of tasks to files in the shared folder, by URI, through Arrow's file systems."""
from __future__ import annotations

import uuid


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, parts) -> int:
    """Writes the parts (bytes) under a name of its own and then moves it: a task that is lost or runs twice never leaves half a file."""
    f, path = _at(uri)
    f.create_dir(path.rpartition("/")[0], recursive=True)
    draft, size = f"{path}.{uuid.uuid4().hex}", 0
    with f.open_output_stream(draft, compression=None) as out:
        for p in parts:
            out.write(p)
            size += len(p)
    f.move(draft, path)
    return size


def get(uri: str) -> bytes:
    f, path = _at(uri)
    with f.open_input_file(path) as src:
        return src.read()


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        f, path = _at(uri)
        self.file = f.open_input_file(path)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
