"""Opening files of any file system that Arrow knows, with transparent decompression."""

from __future__ import annotations

import io
import lzma

import pyarrow as pa
from pyarrow import fs

ZSTD_MAGIC, GZIP_MAGIC, BZIP_MAGIC, XZ_MAGIC = b"\x28\xb5\x2f\xfd", b"\x1f\x8b", b"BZh", b"\xfd7zXZ"


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def expand(paths: str, suffixes: tuple[str, ...] = ()) -> list[str]:
    """Files named by a comma-separated list of files and folders; of folders the files with one of ``suffixes``, by name."""
    out = []
    for path in (p.strip() for p in paths.split(",") if p.strip()):
        system, inner = locate(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.Directory:
            names = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File)
            prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            out += [prefix + n for n in names if not suffixes or n.endswith(suffixes)]
        else:
            out.append(path)
    return out


def exists(path: str) -> bool:
    system, inner = locate(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def size(path: str) -> int:
    system, inner = locate(path)
    return system.get_file_info(inner).size


def compression(path: str) -> str | None:
    """How a file is compressed, by what it starts with."""
    system, inner = locate(path)
    with system.open_input_stream(inner, compression=None) as probe:
        magic = bytes(probe.read(5))
    return "zstd" if magic[:4] == ZSTD_MAGIC else "gzip" if magic[:2] == GZIP_MAGIC else "bz2" if magic[:3] == BZIP_MAGIC else "xz" if magic == XZ_MAGIC else None


def open_input(path: str):
    """A readable binary stream, decompressed by what the file starts with."""
    kind = compression(path)
    system, inner = locate(path)
    raw = system.open_input_stream(inner, compression=None)
    if kind == "xz":
        return lzma.open(pa.PythonFile(raw, mode="r"))
    return io.BufferedReader(pa.PythonFile(pa.CompressedInputStream(raw, kind) if kind else raw, mode="r"), 1 << 20)


def open_output(path: str, compression: str | None = None):
    system, inner = locate(path)
    folder = inner.rsplit("/", 1)[0]
    if folder and folder != inner:
        system.create_dir(folder, recursive=True)
    return system.open_output_stream(inner, compression=compression)


def delete(path: str) -> None:
    system, inner = locate(path)
    system.delete_file(inner)


def replace(path: str, final: str) -> None:
    """Give a finished file its final name, in place of an older one."""
    system, inner = locate(path)
    target = locate(final)[1]
    try:
        system.move(inner, target)
    except OSError:  # file systems that don't move onto a file
        if system.get_file_info(target).type == fs.FileType.NotFound:
            raise
        system.delete_file(target)
        system.move(inner, target)
