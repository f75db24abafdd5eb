"""Mergeable distinct counts by set sketches with registers on a logarithmic scale of tunable base.

A sketch of m registers holds, for every register i, ``max(floor(1 - log_b h_i(x)))`` over the members x, where the
``h_i`` are independent exponential values of rate a drawn from a hash of x. It does not depend on order or repetition and
is merged by the larger register, so partial sketches of days, files or groups add up to the sketch of their union.
The relative standard error of the count, for sets of any size, is ``sqrt(((b+1)/(b-1) ln b - 1)/m)``. Two sketches
give union, intersection and Jaccard coefficient together, as the maximum of the likelihood of the numbers of registers
in which the first is larger, the second is larger, and both agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import present


@dataclass(frozen=True)
class SketchConfig:
    """m registers of one byte, base b, rate a. Base 1.2 covers sets of up to about 1e19 members with one byte."""

    m: int = 256
    b: float = 1.2
    a: float = 20.0

    @property
    def error(self) -> float:
        b = self.b
        return math.sqrt(((b + 1) / (b - 1) * math.log(b) - 1) / self.m)


#: Cells a task holds before it passes partial sketches on; only memory depends on it.
CELLS_HELD = 16_384


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lowest(cell: np.ndarray, member: np.ndarray, m: int, low: np.ndarray) -> None:
    """low[c, i]: the smallest hash value of register i over the members of cell c (smallest value, largest register)."""
    order = np.lexsort((member, cell))
    cell, member = cell[order], member[order]
    first = np.ones(len(cell), dtype=bool)
    first[1:] = (cell[1:] != cell[:-1]) | (member[1:] != member[:-1])
    cell, member = cell[first], member[first]
    step = (np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    block = max(8, 2**17 // m)  # a megabyte of values, which stays in the processor's cache
    for at in range(0, len(cell), block):
        c = cell[at : at + block]
        values = _mix(member[at : at + block, None] + step)
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        rows = c[starts]
        low[rows] = np.minimum(low[rows], np.minimum.reduceat(values, starts, axis=0))


def _registers(low: np.ndarray, config: SketchConfig) -> np.ndarray:
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / config.a
    return np.clip(np.floor(1 - np.log(h) / math.log(config.b)), 0, 255).astype(np.uint8)


def _keys_table(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, pa.Table]:
    """Code of each row's key combination, and the combinations."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        d = batch.column(k).dictionary_encode(null_encoding="encode")
        code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return code, pa.Table.from_batches([batch]).select(keys).take(pa.array(first))


def _sketch_task(keys: list[str], config: SketchConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple, int] = {}
        low = np.full((64, config.m), np.uint64(2**64 - 1))
        rows = np.zeros(64, dtype=np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            if index:
                n = len(index)
                reg = _registers(low[:n], config)
                columns = [pa.array([k[i] for k in index], pa.string()) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[:n]), pa.array([r.tobytes() for r in reg], pa.binary())], names=[*keys, "n_rows", "registers"])

        for batch in batches:
            if not batch.num_rows:
                continue
            code, combos = _keys_table(batch, keys)
            member = batch.column("member").to_numpy(zero_copy_only=False).view(np.uint64)
            slots = np.empty(combos.num_rows, dtype=np.int64)
            for i, key in enumerate(zip(*(combos.column(k).to_pylist() for k in keys), strict=True)):
                slots[i] = index.setdefault(key, len(index))
            while len(index) > len(low):
                low = np.vstack([low, np.full_like(low, np.uint64(2**64 - 1))])
                rows = np.r_[rows, np.zeros_like(rows)]
            cell = slots[code]
            rows[: len(index)] += np.bincount(cell, minlength=len(index))
            _lowest(cell, member, config.m, low)
            if len(index) > CELLS_HELD:
                yield from flush()
                index.clear()
                low[:] = np.uint64(2**64 - 1)
                rows[:] = 0
        yield from flush()

    return run


def _merge_task(keys: list[str], config: SketchConfig, in_order: bool):
    """Larger registers of equal keys. With rows in order each key comes out once, else once for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if kept is not None:
                t = pa.concat_tables([kept, t])
            if not t.num_rows:
                continue
            t = t.combine_chunks()
            code, combos = _keys_table(t.to_batches()[0], keys)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            reg = np.frombuffer(b"".join(t.column("registers").to_pylist()), dtype=np.uint8).reshape(-1, config.m)
            best = np.maximum.reduceat(reg[order], starts, axis=0)
            n = np.add.reduceat(t.column("n_rows").to_numpy()[order], starts)
            out = pa.table([*[combos.column(k).combine_chunks() for k in keys], pa.array(n), pa.array([r.tobytes() for r in best], pa.binary())], names=[*keys, "n_rows", "registers"])
            if in_order:  # the last key may go on in the next batch
                last = code[-1]
                kept = out.slice(last, 1)
                out = pa.concat_tables([out.slice(0, last), out.slice(last + 1)])
            yield from out.combine_chunks().to_batches()
        if kept is not None:
            yield from kept.to_batches()

    return run


def _schema(keys: Sequence[str]) -> str:
    return ", ".join([*[f"`{k}` STRING" for k in keys], "n_rows BIGINT", "registers BINARY"])


def merge_sketches(sketches: DataFrame, keys: Sequence[str], config: SketchConfig = SketchConfig()) -> DataFrame:
    """One sketch for each combination of ``keys``: also how cells are rolled up to coarser keys and how new days are added to old ones.

    Partial sketches are merged before the shuffle; after it a task streams over its keys in order, holding one sketch.
    """
    keys = list(keys)
    slim = sketches.select(*keys, "n_rows", "registers")
    local = slim.mapInArrow(_merge_task(keys, config, False), _schema(keys))
    return local.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_task(keys, config, True), _schema(keys))


def sketch(df: DataFrame, keys: Sequence[str], member: str, config: SketchConfig = SketchConfig(), null_keys: bool = False) -> DataFrame:
    """Sketches (keys as strings, n_rows, registers) of the distinct ``member`` values of each key combination.

    Rows with a null member are left out, and those with a null key unless ``null_keys`` keeps null as a key of its own, as sketches that
    are to be rolled up to fewer keys need it; repeated rows count in ``n_rows`` only. An empty input gives no row.
    """
    keys = list(keys)
    rows = present(df, *([] if null_keys else keys), member).select(*[F.col(k).cast("string").alias(k) for k in keys], F.xxhash64(member).alias("member"))
    return merge_sketches(rows.mapInArrow(_sketch_task(keys, config), _schema(keys)), keys, config)


def _count_task(config: SketchConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reg = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.uint8).reshape(-1, config.m)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(estimate_counts(reg, config)), pa.array(np.full(len(reg), config.error))], names=[*batch.schema.names, "n_distinct", "rel_error"])

    return run


def estimate_counts(registers: np.ndarray, config: SketchConfig) -> np.ndarray:
    s = np.exp2(-registers.astype(np.float64) * math.log2(config.b)).sum(axis=1)
    return config.m * (1 - 1 / config.b) / (config.a * math.log(config.b) * s)


def with_counts(sketches: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """Adds ``n_distinct`` (estimate) and ``rel_error`` (its relative standard error)."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in sketches.schema]
    return sketches.mapInArrow(_count_task(config), ", ".join([*names, "n_distinct DOUBLE", "rel_error DOUBLE"]))


def cube(sketches: DataFrame, keys: Sequence[str], config: SketchConfig = SketchConfig()) -> DataFrame:
    """Sketches of every non-empty combination of ``keys``; a key that plays no part is null there.

    A null key leaves a sketch out of the combinations that have this key, not out of the others: give sketches made with ``null_keys``.
    """
    keys = list(keys)
    sets = [[k for i, k in enumerate(keys) if bits >> i & 1] for bits in range(1, 2 ** len(keys))]
    # Nulls of keys that play a part are dropped, so a null in the result always stands for a key that plays none.
    cells = [F.when(reduce(and_, [F.col(f"`{k}`").isNotNull() for k in s]), F.struct(*[(F.col(f"`{k}`") if k in s else F.lit(None).cast("string")).alias(k) for k in keys])) for s in sets]
    many = sketches.select(F.explode(F.array(*cells)).alias("cell"), "n_rows", "registers").where("cell IS NOT NULL")
    return merge_sketches(many.select("cell.*", "n_rows", "registers"), keys, config)


def joint_jaccard(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard coefficients by maximum likelihood (golden-section search, all pairs at once) and their standard errors."""
    total = n_a + n_b
    u, v = n_a / total, n_b / total

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (b - 1) / b) / math.log(b)

    def parts(j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        up, down = p(np.clip(u - v * j, 0, 1)), p(np.clip(v - u * j, 0, 1))
        return up, down, 1 - up - down

    def ll(j: np.ndarray) -> np.ndarray:
        return sum(np.where(c > 0, c * np.log(np.maximum(q, 1e-300)), 0.0) for c, q in zip((larger, smaller, equal), parts(j), strict=True))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    top = hi.copy()
    g = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        right = ll(x) < ll(y)
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
    j = (lo + hi) / 2
    e = 1e-4
    at = np.clip(j, e, np.maximum(top - e, e))
    info = sum(((q1 - q0) / (2 * e)) ** 2 / np.maximum(q, 1e-9) for q0, q, q1 in zip(parts(at - e), parts(at), parts(at + e), strict=True)) * (larger + smaller + equal)
    return j, 1 / np.sqrt(np.maximum(info, 1e-12))


def _joint_task(config: SketchConfig, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, config.m) for c in ("registers_a", "registers_b"))
            n_a, n_b = estimate_counts(a, config), estimate_counts(b, config)
            j, err = joint_jaccard((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), n_a, n_b, config.b)
            union = (n_a + n_b) / (1 + j)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *map(pa.array, (n_a, n_b, union, union * j, j, err))], names=[*names, "n_a", "n_b", "n_union", "n_shared", "jaccard", "jaccard_error"])

    return run


def joint_counts(pairs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """Rows with ``registers_a`` and ``registers_b`` get n_a, n_b, n_union, n_shared, jaccard and jaccard_error (standard error) in place of the registers."""
    kept = [f for f in pairs.schema if f.name not in ("registers_a", "registers_b")]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{n} DOUBLE" for n in ("n_a", "n_b", "n_union", "n_shared", "jaccard", "jaccard_error")]])
    return pairs.mapInArrow(_joint_task(config, [f.name for f in kept]), out)


def repeated_cells(df: DataFrame, keys: Sequence[str], member: str, min_rows: int, max_ratio: float, config: SketchConfig = SketchConfig()) -> DataFrame:
    """Cells (keys, n_rows, n_distinct, rel_error) of at least ``min_rows`` rows whose estimated number of distinct members is at most ``max_ratio`` of their rows.

    Rows are read once. The estimate decides: a cell at a true ratio r is taken as if it were at ``r (1 + e)``, e of standard error
    ``rel_error``, so put ``max_ratio`` several errors from the ratios that must be told apart (see :func:`cut_between`).
    """
    counted = with_counts(sketch(df, list(keys), member, config), config)
    return counted.where((F.col("n_rows") >= min_rows) & (F.col("n_distinct") <= F.col("n_rows") * max_ratio)).drop("registers")


def cut_between(low: float, high: float, config: SketchConfig = SketchConfig()) -> tuple[float, float]:
    """The ratio that lies as many standard errors above ``low`` as below ``high``, and that number."""
    cut = 2 * low * high / (low + high)
    return cut, (high - cut) / (high * config.error)
