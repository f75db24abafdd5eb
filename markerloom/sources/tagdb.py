"""``tagdb``: compact marker databases, a genome list followed by records ``u64 hash, u32 genome index``."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import files

MAGIC = b"IIBC"  # fixed value
RECORD = np.dtype([("hash", "<i8"), ("index", "<u4")])
SUFFIXES = (".iibdb",)
BATCH = 65_536


def is_compact(path: str) -> bool:
    """Whether a file is a compact database; a file of fewer than four bytes is none."""
    with files.open_input(path) as f:
        return f.read(4) == MAGIC


def read_header(stream) -> tuple[int, int | None, list[str]]:
    """Version, number of records (version 3, else null), genome ids; the stream then stands at the records."""

    def take(n: int) -> bytes:
        raw = stream.read(n)
        if len(raw) < n:
            raise ValueError("compact database ends inside its header")
        return raw

    if take(4) != MAGIC:
        raise ValueError("not a compact database")
    version = struct.unpack("<I", take(4))[0]
    if version not in (1, 2, 3):
        raise ValueError(f"unknown version {version} of a compact database")
    count = struct.unpack("<Q", take(8))[0] if version == 3 else None
    genomes = [take(struct.unpack("<H", take(2))[0]).decode("utf-8", "replace") for _ in range(struct.unpack("<I", take(4))[0])]
    return version, count, genomes


def records(stream, version: int) -> Iterator[np.ndarray]:
    if version > 1:
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    rest = b""
    while raw := stream.read(BATCH * RECORD.itemsize):
        raw = rest + raw
        whole = len(raw) // RECORD.itemsize * RECORD.itemsize
        rest = raw[whole:]
        if whole:
            yield np.frombuffer(raw[:whole], dtype=RECORD)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files.expand(options["path"], SUFFIXES)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with files.open_input(partition.path) as stream:
            version, _, genomes = read_header(stream)
            names = pa.array([*genomes, None], pa.string())
            for block in records(stream, version):
                index = block["index"].astype(np.int64)
                where = np.where(index < len(genomes), index, len(genomes))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(block)), pa.array(block["hash"].astype(np.int64)), pa.array(index), names.take(pa.array(where))], names=["file", "hash", "gcf_index", "gcf_id"])


class _Done(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    """One file is one task: bring the rows into one partition. Records go beside the file first, as its head needs the genome list."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import zstandard
        from pyspark import TaskContext

        if TaskContext.get().partitionId():
            if any(True for _ in rows):
                raise ValueError("write a compact database from one partition")
            return _Done()
        index: dict[str, int] = {}
        count, beside = 0, f"{self.path}.records.tmp"
        with files.open_output(beside) as raw, zstandard.ZstdCompressor(level=3).stream_writer(raw, closefd=False) as out:
            for row in rows:
                if row["hash"] is None or row["gcf_id"] is None:
                    continue
                out.write(struct.pack("<qI", row["hash"], index.setdefault(row["gcf_id"], len(index))))
                count += 1
        with files.open_output(self.path) as out:
            out.write(MAGIC + struct.pack("<IQI", 3, count, len(index)))
            for g in index:
                name = g.encode()[:65535]
                out.write(struct.pack("<H", len(name)) + name)
            system, inner = files.locate(beside)
            with system.open_input_stream(inner, compression=None) as packed:
                while block := packed.read(1 << 20):
                    out.write(block)
        files.delete(beside)
        return _Done()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        for path in (self.path, f"{self.path}.records.tmp"):
            try:
                files.delete(path)
            except OSError:
                pass


class TagDbSource(DataSource):
    """Columns file, hash (signed 64 bits), gcf_index, gcf_id (null for an index beyond the list); written, as version 3, from hash and gcf_id."""

    @classmethod
    def name(cls) -> str:
        return "tagdb"

    def schema(self) -> str:
        return "file STRING, hash BIGINT, gcf_index BIGINT, gcf_id STRING"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
