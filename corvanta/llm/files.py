"""Files in the shared folder, from driver and executors alike."""

from __future__ import annotations

import posixpath
from urllib.parse import urlparse

import pyarrow.fs as pafs


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ...) and the path in it."""
    if not urlparse(uri).scheme:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write a file that appears under its name only when it is whole."""
    fs, path = located(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path + ".part") as out:
        out.write(data)
    fs.move(path + ".part", path)
