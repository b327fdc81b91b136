"""Plain files under the shared folder, written and read inside tasks.

``pyarrow.fs`` opens them by URI, so any store that it knows will do. A file is written
under a temporary name and moved into place when complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file whole or not at all; returns its bytes."""
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    store.move(part, path)
    return n


def get(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        return f.read()
