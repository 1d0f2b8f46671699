"""Bytes of files in the shared folder, at any address that pyarrow reaches."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_fs(uri: str):
    """(file system, path) of a path or URI (file, hdfs, s3, gs, viewfs, ..)."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("viewfs:"):
        return pafs.HadoopFileSystem("viewfs://" + uri.split("://", 1)[1].split("/", 1)[0]), "/" + uri.split("://", 1)[1].split("/", 1)[1]
    return pafs.FileSystem.from_uri(uri)


def put(folder: str, name: str, data: bytes) -> str:
    """Write one file; the folder is made if it is absent."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(data)
    return f"{folder}/{name}"


def get(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()
