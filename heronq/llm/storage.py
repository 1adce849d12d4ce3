"""Files in the shared folder, opened from executors: any place that pyarrow's filesystems reach (local, HDFS, S3, GCS)."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def attempt_path(folder: str, stem: str, suffix: str) -> str:
    """A name that no other attempt at the same task has, so a rerun never writes into a file that is read."""
    return f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"


def open_out(uri: str):
    where, path = filesystem(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def open_in(uri: str):
    where, path = filesystem(uri)
    return where.open_input_file(path)


def read_range(uri: str, start: int, length: int) -> bytes:
    with open_in(uri) as f:
        f.seek(start)
        return f.read(length)


def remove(uri: str) -> None:
    where, path = filesystem(uri)
    where.delete_file(path)


def write_arrays(folder: str, stem: str, **arrays) -> str:
    buffer, path = io.BytesIO(), attempt_path(folder, stem, ".npz")
    np.savez(buffer, **arrays)
    with open_out(path) as f:
        f.write(buffer.getvalue())
    return path


def read_arrays(path: str) -> dict[str, np.ndarray]:
    with open_in(path) as f:
        return dict(np.load(io.BytesIO(f.read()), allow_pickle=False))
