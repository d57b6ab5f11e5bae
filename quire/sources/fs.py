"""File access for Python-side sinks and readers through ``pyarrow.fs``, so a
path may be local or any URI pyarrow resolves (``hdfs://``, ``s3://``, ...)."""

from __future__ import annotations

import fnmatch
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyarrow import fs as pafs


COPY_BYTES = 4 << 20
DELETERS = 8


def resolve(uri: str):
    """(filesystem, path) for a URI or an absolute local path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def join(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *[p.strip("/") for p in parts]])


def write_atomic(uri: str, data: bytes) -> None:
    """Write to a temporary name next to the target, then rename: a retried
    task rewrites the same file."""
    fs, path = resolve(uri)
    parent = path.rsplit("/", 1)[0]
    fs.create_dir(parent, recursive=True)
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, path)


@contextmanager
def folder_atomic(uri: str):
    """A folder of a hidden name beside the target, renamed when the block ends well.  Within, files are
    written where they stay: small files cost one entry of a folder that no other task writes to.  A
    folder that is there already is of an earlier try of the same task, and stays."""
    fs, path = resolve(uri)
    parent, name = path.rsplit("/", 1)
    tmp = f"{parent}/_{name}-{uuid.uuid4().hex[:8]}"
    fs.create_dir(tmp, recursive=True)
    yield fs, tmp
    try:
        fs.move(tmp, path)
    except OSError:
        if fs.get_file_info(path).type != pafs.FileType.Directory:
            raise
        fs.delete_dir(tmp)


@contextmanager
def stream_after(fs, path: str, start: int):
    """A stream that writes behind the first ``start`` bytes of a file; what a try before has left behind them
    is replaced.  Stores that cannot append write the file anew."""
    info = fs.get_file_info(path)
    have = info.size if info.type == pafs.FileType.File else 0
    if have < start:
        raise ValueError(f"{path}: {have} of {start} bytes")
    if start == 0:
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            yield out
        return
    try:
        out = fs.open_append_stream(path) if have == start else None
    except NotImplementedError:
        out = None
    if out is not None:
        with out:
            yield out
        return
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(tmp) as out:
        with fs.open_input_file(path) as old:
            for at in range(0, start, COPY_BYTES):
                out.write(old.read_at(min(COPY_BYTES, start - at), at))
        yield out
    fs.move(tmp, path)


def size(uri: str) -> int:
    fs, path = resolve(uri)
    return fs.get_file_info(path).size


def exists(uri: str) -> bool:
    fs, path = resolve(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def delete_folder(uri: str) -> None:
    """Delete a folder and what is in it, its folders side by side; nothing if it is not there."""
    fs, path = resolve(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        inner = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.Directory]
        if len(inner) > 1:
            with ThreadPoolExecutor(DELETERS) as pool:
                list(pool.map(fs.delete_dir, inner))
        fs.delete_dir(path)


def open_file(uri: str):
    """A file open for ranged reads."""
    fs, path = resolve(uri)
    return fs.open_input_file(path)


def read_range(uri: str, offset: int, nbytes: int) -> bytes:
    fs, path = resolve(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(nbytes, offset)


@contextmanager
def stream_atomic(uri: str):
    """A stream to a temporary name next to the target, renamed when the block
    ends well: a retried task rewrites the same file."""
    fs, path = resolve(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(tmp) as out:
        yield out
    fs.move(tmp, path)


def listing(pattern: str) -> list[tuple[str, int]]:
    """(file, bytes) of the files matching a pattern whose wildcards are in the
    last path part; a directory means all its ``*.bin`` files.  One listing, no
    file is opened."""
    fs, path = resolve(pattern)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.Directory:
        folder, pat = path, "*.bin"
    elif info.type == pafs.FileType.File:
        return [(_uri(pattern, path), info.size)]
    else:
        folder, pat = path.rsplit("/", 1)
    found = fs.get_file_info(pafs.FileSelector(folder, recursive=False))
    return sorted((_uri(pattern, f.path), f.size) for f in found
                  if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pat))


def _uri(original: str, path: str) -> str:
    """Put the scheme of ``original`` back in front of a resolved path."""
    if "://" in original and not original.startswith("file://"):
        scheme, rest = original.split("://", 1)
        if scheme in ("s3", "gs", "gcs"):
            return f"{scheme}://{path.lstrip('/')}"
        return f"{scheme}://{rest.split('/', 1)[0]}{path}"
    return path
