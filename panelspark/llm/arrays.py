"""Flat little-endian arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs as pafs

from panelspark.llm.common import worker_cache

#: Sets of files whose maps a worker keeps open; where files are read, that many are held.
_OPEN, _READ = 2048, 8


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """One file per array; the returned path names the attempt, so retried tasks do no harm."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    base = f"{name}-{uuid.uuid4().hex}"
    for suffix, values in arrays.items():
        with fs.open_output_stream(f"{root}/{base}.{suffix}") as f:
            f.write(np.ascontiguousarray(values).tobytes())
    return f"{folder}/{base}"


def map_array(path: str, kind: str) -> np.ndarray:
    """The array of a file: a memory map where the shared folder is mounted, else read."""
    fs, inner = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(inner, dtype=kind, mode="r") if fs.get_file_info(inner).size else np.empty(0, kind)
    with fs.open_input_file(inner) as f:
        return np.frombuffer(f.read(), dtype=kind)


def mapped(path: str, *kinds: tuple[str, str]) -> tuple[np.ndarray, ...]:
    """The arrays (suffix, kind) below a path, kept between batches: maps, or a few that were read."""
    known = worker_cache("maps")
    if path not in known:
        if len(known) >= (_OPEN if path.startswith(("file:", "/")) else _READ):
            known.clear()
        known[path] = tuple(map_array(f"{path}.{suffix}", kind) for suffix, kind in kinds)
    return known[path]
