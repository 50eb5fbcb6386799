"""Files of the shared store, by URI. Kept free of heavy imports: Python workers that only read and write use it."""

from __future__ import annotations

from pyarrow import fs


def open_out(uri: str):
    """A stream to a new file."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def read_whole(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()
