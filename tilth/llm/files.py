"""Files in the shared folder, by URI, from the driver and from executors (file, hdfs, s3, gs: what pyarrow.fs opens)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def write(uri: str, data: bytes) -> None:
    """All of the file or none: a task that is run again replaces it by the same bytes."""
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def read(uri: str, start: int = 0, size: int | None = None) -> bytes:
    system, path = at(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size) if size is not None else f.read()
