"""Files of our own formats in the folder that all executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Spark's ``file:/x`` and plain paths are local; any other URI is pyarrow's to open."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_whole(uri: str, data: bytes) -> None:
    """Whole or not at all: a second try of the same task replaces the file with the same bytes."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def read_whole(uri: str) -> bytes | memoryview:
    """A file's bytes; those of a POSIX path are mapped, and read as they are touched."""
    fs, path = file_system(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return memoryview(pa.memory_map(path).read_buffer())
    with fs.open_input_file(path) as f:
        return f.read()
