"""Files of plain bytes on any file system that Arrow or the machine knows."""

from __future__ import annotations

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it) of a URI or of a plain path on this machine."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        return fs.LocalFileSystem(), path[5:]
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def size(path: str) -> int:
    """Bytes; a missing file raises OSError."""
    f, p = resolve(path)
    info = f.get_file_info(p)
    if info.type != fs.FileType.File:
        raise OSError(f"no such file: {path}")
    return info.size


def exists(path: str) -> bool:
    f, p = resolve(path)
    return f.get_file_info(p).type == fs.FileType.File


def read(path: str, start: int, n: int) -> bytes:
    f, p = resolve(path)
    with f.open_input_file(p) as x:
        return x.read_at(n, start)
