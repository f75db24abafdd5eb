"""``spark.read.format("fastx")``: FASTA and FASTQ files, plain or compressed.

Plain files are read in byte ranges, each record by the range it begins in; a compressed file is one partition. FASTA begins a record
with each line that starts with ``>``. In FASTQ, where a line of qualities may start with ``@``, a record begins at the ``@`` line
that is followed by bases, a ``+`` line and as many qualities.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

SUFFIXES = tuple(f"{s}{z}" for s in (".fa", ".fna", ".fasta", ".fq", ".fastq") for z in ("", ".gz", ".zst", ".bz2", ".xz"))


#: Records and bases that are passed on together; only memory depends on them.
BATCH_ROWS, BATCH_BASES = 8_192, 1 << 24
#: Plain files of more bytes are read in parts of this size.
SPLIT_BYTES = 128 << 20


def _text(line: bytes) -> str:
    return line.decode("utf-8", "replace").rstrip("\r\n")


def _fastq(first: bytes, lines: Iterator[bytes]) -> tuple[tuple[str, str, str], int]:
    """The record that begins with ``first``, and the bytes of its other lines; raises if it is broken."""
    rest = list(islice(lines, 3))
    if len(rest) == 3:
        bases, plus, quality = map(_text, rest)
        if plus.startswith("+") and len(bases) == len(quality):
            return (_text(first)[1:], bases, quality), sum(map(len, rest))
    raise ValueError(f"broken FASTQ record {_text(first)!r}")


def places(lines: Iterator[bytes], at: int = 0) -> Iterator[tuple[int, tuple[str, str, str | None]]]:
    """(place of the first byte, (header, sequence, qualities or null)) of each record. FASTA sequences may span lines; broken records raise."""
    header, seq, began = None, [], at
    for line in lines:
        text = _text(line)
        if text.startswith(">"):
            if header is not None:
                yield began, (header, "".join(seq), None)
            header, seq, began = text[1:], [], at
        elif header is not None:
            seq.append(text.strip())
        elif text.startswith("@"):
            record, more = _fastq(line, lines)
            yield at, record
            at += more
        elif text:
            raise ValueError(f"neither FASTA nor FASTQ: {text[:40]!r}")
        at += len(line)
    if header is not None:
        yield began, (header, "".join(seq), None)


def parse(stream) -> Iterator[tuple[str, str, str | None]]:
    """The records of a stream of lines, see :func:`places`."""
    return (record for _, record in places(iter(stream)))


@dataclass(frozen=True)
class _Part(InputPartition):
    """The records of a file that begin in [start, end); all of it where ``end`` is none."""

    path: str
    start: int = 0
    end: int | None = None


def _begins(lines: list[bytes], fastq: bool) -> bool:
    """Whether a record begins with the first of these lines; for FASTQ three more are needed."""
    if not fastq:
        return lines[0].startswith(b">")
    bases, plus, quality = map(_text, lines[1:4])
    return lines[0].startswith(b"@") and plus.startswith("+") and len(bases) == len(quality) and not bases.startswith(("@", "+"))


def records_of_range(path: str, start: int, end: int) -> Iterator[tuple[int, tuple[str, str, str | None]]]:
    """(place of its first byte, record) of the records of a plain file that begin in the range."""
    system, inner = files.locate(path)
    with system.open_input_file(inner) as raw:
        fastq = raw.read_at(4096, 0).lstrip()[:1] == b"@"
        raw.seek(max(start - 1, 0))
        stream = io.BufferedReader(pa.PythonFile(raw, mode="r"), 1 << 20)
        at, need = start, 4 if fastq else 1
        ahead: list[bytes] = []
        if start:
            at = start - 1 + len(stream.readline())  # the rest of a line that began before
            while True:  # lines of a record that began before
                ahead += islice(stream, need - len(ahead))
                if len(ahead) < need or at >= end:
                    return
                if _begins(ahead, fastq):
                    break
                at += len(ahead.pop(0))
        for place, record in places(chain(ahead, stream), at):
            if place >= end:
                return
            yield place, record


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files.expand(options["path"], SUFFIXES)
        self.split = int(options.get("split", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        parts = []
        for p in self.paths:
            size = files.size(p)
            if size > self.split and files.compression(p) is None:
                parts += [_Part(p, at, min(at + self.split, size)) for at in range(0, size, self.split)]
            else:
                parts.append(_Part(p))
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            ordinal, records = zip(*rows, strict=True)
            header, seq, qual = zip(*records, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array(ordinal, pa.int64()), pa.array(header, pa.string()), pa.array(seq, pa.string()), pa.array(qual, pa.string())], names=["file", "ordinal", "header", "seq", "qual"])

        with files.open_input(partition.path) if partition.end is None else nullcontext() as stream:
            found = enumerate(parse(stream), 1) if partition.end is None else ((at + 1, r) for at, r in records_of_range(partition.path, partition.start, partition.end))
            for row in found:
                rows.append(row)
                held += len(row[1][1])
                if len(rows) == BATCH_ROWS or held >= BATCH_BASES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class FastxSource(DataSource):
    """Columns file, ordinal, header (whole line), seq, qual (null in FASTA). Options path: files or folders, by comma; split: bytes of a plain file beyond which it is read in parts of that size.

    ``ordinal`` counts the records of a file from 1; in a file read in parts it is the byte, from 1, at which the record begins: the same order, other numbers.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return "file STRING, ordinal BIGINT, header STRING, seq STRING, qual STRING"

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(self.options)


def register(spark: SparkSession) -> None:
    from .tagdb import TagDbSource
    from .tagstream import TagStreamSource

    for source in (FastxSource, TagStreamSource, TagDbSource):
        spark.dataSource.register(source)
