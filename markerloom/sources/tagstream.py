"""``tagstream``: files of records ``u64 hash, u16 length, id bytes`` (little endian), plain, zstd or gzip."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import files

SUFFIXES = (".iibsp", ".iibdb", ".iibsp.gz", ".iibdb.gz", ".iibsp.zst", ".iibdb.zst")
LONGEST_ID = 65535
#: Records that are passed on together.
BATCH_ROWS = 65_536


def parse(stream) -> Iterator[tuple[int, str]]:
    """(signed hash, id). A file may end inside a hash; one that ends inside an id is broken."""
    while len(head := stream.read(8)) == 8:
        size = stream.read(2)
        n = int.from_bytes(size, "little")
        name = stream.read(n) if len(size) == 2 else b""
        if len(size) < 2 or len(name) < n:
            raise ValueError("record stream ends inside an id")
        yield int.from_bytes(head, "little", signed=True), name.decode("utf-8", "replace")


def pack(tag_hash: int, name: str) -> bytes:
    raw = name.encode()[:LONGEST_ID]
    return struct.pack("<qH", tag_hash, len(raw)) + raw


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files.expand(options["path"], SUFFIXES)
        self.skip_broken = options.get("broken", "fail") == "skip"

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def _whole(self, path: str) -> bool:
        try:
            with files.open_input(path) as stream:
                for _ in parse(stream):
                    pass
        except (ValueError, OSError):
            return False
        return True

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if self.skip_broken and not self._whole(partition.path):
            return
        with files.open_input(partition.path) as stream:
            records, first = parse(stream), 1
            while rows := list(islice(records, BATCH_ROWS)):
                h, names = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(h, pa.int64()), pa.array(names, pa.string())], names=["file", "ordinal", "hash", "id"])
                first += len(rows)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    """A file for each task; a task that fails or runs twice leaves no second file in the result."""

    def __init__(self, options: dict):
        self.path, self.compression = options["path"].rstrip("/"), options.get("compression", "zstd")
        self.compression = None if self.compression in ("none", "") else self.compression

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        end = {"zstd": ".zst", "gzip": ".gz", None: ""}[self.compression]
        path, out = f"{self.path}/part-{task.partitionId():05d}-{task.taskAttemptId()}.iibsp{end}", None
        for row in rows:
            if row["hash"] is None or row["id"] is None:
                continue
            out = out or files.open_output(path, self.compression)
            out.write(pack(row["hash"], row["id"]))
        if out is None:
            return _Written(None)
        out.close()
        return _Written(path)

    def commit(self, messages: list) -> None:
        files.open_output(f"{self.path}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path:
                files.delete(m.path)


class TagStreamSource(DataSource):
    """Columns file, ordinal, hash (signed 64 bits), id; written from columns hash and id. Options path, compression (zstd, gzip, none), broken (fail, skip: leave a file out that can't be read to its end)."""

    @classmethod
    def name(cls) -> str:
        return "tagstream"

    def schema(self) -> str:
        return "file STRING, ordinal BIGINT, hash BIGINT, id STRING"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
