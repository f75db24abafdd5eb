"""One file for each sample or genome, written by the tasks that hold their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, tagstream


def _write_task(columns: list[str], encode: Callable, header: bytes):
    """A file for each owner, in the order the rows come: written beside its place under the task attempt's name, and moved there when whole, so that a second attempt never touches a file in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        path, out, n, done = None, None, 0, []

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None
                files.replace(f"{path}.{attempt}.tmp", path)
                done.append((path, n))

        try:
            for batch in batches:
                for owner, *values in zip(*(batch.column(c).to_pylist() for c in ("owner", *columns)), strict=True):
                    if owner != path:
                        finish()
                        path, n, out = owner, 0, files.open_output(f"{owner}.{attempt}.tmp")
                        out.write(header)
                    out.write(encode(*values))
                    n += 1
            finish()
        except BaseException:
            if out is not None:
                out.close()
                files.delete(f"{path}.{attempt}.tmp")
            raise
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n_records"])

    return run


def write_streams(records: DataFrame, owner: str, folder: str, suffix: str, order: list[str]) -> DataFrame:
    """Record streams ``<folder>/<owner><suffix>`` from columns hash and id, each in ``order``: a task streams through whole owners, so one file is never in memory. Returns (path, n_records)."""
    rows = records.select(F.concat(F.lit(f"{folder.rstrip('/')}/"), F.col(owner), F.lit(suffix)).alias("owner"), "hash", "id", *order).dropna(subset=["owner", "hash", "id"])
    sorted_rows = rows.repartition("owner").sortWithinPartitions("owner", *order).select("owner", "hash", "id")
    return sorted_rows.mapInArrow(_write_task(["hash", "id"], tagstream.pack, b""), "path STRING, n_records BIGINT")


def write_tables(lines: DataFrame, path: Column, order: list[str], header: str | None = None) -> DataFrame:
    """Text files, one for each value of ``path``, from column line in ``order``: all samples' files in one job. Returns (path, n_records)."""
    rows = lines.select(path.alias("owner"), "line", *[c for c in order if c != "line"]).dropna(subset=["owner", "line"])
    sorted_rows = rows.repartition("owner").sortWithinPartitions("owner", *order).select("owner", "line")
    top = header.encode() + b"\n" if header is not None else b""
    return sorted_rows.mapInArrow(_write_task(["line"], lambda line: line.encode() + b"\n", top), "path STRING, n_records BIGINT")


def load_streams(spark: SparkSession, owners: list[tuple[str, str]]) -> DataFrame:
    """(sample, hash, id) of the record streams listed as (sample, path)."""
    if not owners:
        return spark.createDataFrame([], "sample STRING, hash BIGINT, id STRING")
    names = spark.createDataFrame([(p, s) for s, p in owners], "file STRING, sample STRING")
    rows = spark.read.format("tagstream").option("path", ",".join(p for _, p in owners)).load()
    return rows.join(F.broadcast(names), "file").select("sample", "hash", "id")


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> int:
    """One text file of a one-column table in its order, passed through the driver row by row; for results of the size of a report."""
    n = 0
    with files.open_output(path) as out:
        if header is not None:
            out.write(header.encode() + b"\n")
        for row in lines.toLocalIterator():
            out.write((row[0] or "").encode() + b"\n")
            n += 1
    return n
