"""Sizes of the overlaps between many large sets, from logarithmic-register sketches.

A sketch of a set holds, for each of ``2**p`` registers, the largest bit rank of the members hashed to it (a byte each; few
occupied registers are packed in four bytes each while that is shorter), and the ``k`` members with the smallest values of a
second hash: at most ``2**p + 8 k`` bytes (18 KB where shares of 0.3 are looked for, 24 KB for 0.1) for a set of any size. Sketches are built in every task and merged by the
larger register and the smaller values.

Which pairs to estimate is searched with the samples. As the second hash is the same for all sets, the share of a set's sample
that another set has is the share of its members that set has, whatever the two sizes: a small set inside a huge one is found as
well as a twin, where registers alone would hide it. The rows of all sets are filtered by a bitmap of the sampled members before
anything is joined, so members that no sample has are never moved.

For each pair found the counts of all pairs of register values, and the matches of the smaller set's sample, give one
joint maximum-likelihood estimate of the three disjoint parts (only a, only b, both), with a standard error. What a sample
holds whole (a set of fewer than ``k`` members) is exact. Pairs whose estimate lies too near the share asked for to be told
from it are counted exactly.

Where every pair is wanted, whatever it shares, ``shared_counts`` counts exactly instead: a sketch can't tell a few shared members from none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, present, sized_broadcast

#: Registers per set, as a power of two.
PRECISION = 14
#: Members a set's sample holds at least; more where smaller shares are looked for, see :func:`sample_size`.
SAMPLE = 256
#: A pair is left out by its sample only if that lies this many standard errors below the share asked for (a miss in some millions).
SEARCH_ERRORS = 5.0
#: A pair nearer than this many standard errors to the share asked for is counted exactly.
DOUBT_ERRORS = 4.0
#: Rows a task turns into partial sketches at once, and the largest bitmap in bits; only memory and the number of rows moved depend on them.
BLOCK_ROWS, BITMAP_BITS = 1 << 20, 1 << 27

_SKETCH = "kind STRING, set STRING, n DOUBLE, whole BOOLEAN, registers BINARY, sample ARRAY<BIGINT>"


def _mix(h: np.ndarray) -> np.ndarray:
    """The second hash: a bijection of 64 bits."""
    x = h + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def register_values(h: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Register (the first p bits) and bit rank (place of the first one among the rest, from 1) of each hash."""
    rest = h << np.uint64(p)
    rank = np.where(rest == 0, 65 - p, 65 - np.frexp(rest.astype(np.float64))[1])
    return (h >> np.uint64(64 - p)).astype(np.int64), np.minimum(rank, 65 - p).astype(np.int64)


def set_size(registers: np.ndarray) -> float:
    """Estimated members of a dense sketch: by the empty registers while there are many, else by the harmonic mean."""
    m = float(len(registers))
    empty = float((registers == 0).sum())
    if empty > 0.08 * m:
        return m * np.log(m / empty)
    return 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-registers.astype(float)).sum()


def unpack(raw: bytes, p: int) -> np.ndarray:
    """Dense registers of a packed sketch."""
    if len(raw) == 1 << p:
        return np.frombuffer(raw, dtype=np.uint8)
    entries = np.frombuffer(raw, dtype=np.uint32)
    out = np.zeros(1 << p, dtype=np.uint8)
    out[entries >> np.uint32(8)] = (entries & np.uint32(0xFF)).astype(np.uint8)
    return out


def _entries(raw: bytes, p: int) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) == 1 << p:
        dense = np.frombuffer(raw, dtype=np.uint8)
        at = np.flatnonzero(dense)
        return at, dense[at].astype(np.int64)
    e = np.frombuffer(raw, dtype=np.uint32).astype(np.int64)
    return e >> 8, e & 0xFF


def _pack(at: np.ndarray, rank: np.ndarray, p: int) -> bytes:
    if 4 * len(at) < 1 << p:
        return ((at << 8) | rank).astype(np.uint32).tobytes()
    out = np.zeros(1 << p, dtype=np.uint8)
    out[at] = rank
    return out.tobytes()


def _reduce(owner: np.ndarray, at: np.ndarray, rank: np.ndarray, sampled_by: np.ndarray, h: np.ndarray, n: int, p: int, k: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Packed registers and sample of each of n owners, from register entries and sampled hashes in any order."""
    order = np.sort((((owner << p) | at) << 7) | rank)
    last = np.r_[(order[1:] >> 7) != (order[:-1] >> 7), True] if len(order) else np.zeros(0, dtype=bool)
    order = order[last]
    who = order >> (7 + p)
    cuts = np.searchsorted(who, np.arange(n + 1))
    at, rank = (order >> 7) & ((1 << p) - 1), order & 127
    packed = [_pack(at[a:b], rank[a:b], p) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    by = np.lexsort((_mix(h), sampled_by))
    h, sampled_by = h[by], sampled_by[by]
    new = np.r_[True, (h[1:] != h[:-1]) | (sampled_by[1:] != sampled_by[:-1])] if len(h) else np.zeros(0, dtype=bool)
    h, sampled_by = h[new], sampled_by[new]
    cuts = np.searchsorted(sampled_by, np.arange(n + 1))
    return packed, [h[a : min(b, a + k)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _keys(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """A number for each row's set, and the sets."""
    kind, name = (t.column(c).combine_chunks().dictionary_encode() for c in ("kind", "set"))
    code = kind.indices.to_numpy().astype(np.int64) * max(len(name.dictionary), 1) + name.indices.to_numpy()
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, t.select(["kind", "set"]).take(pa.array(first))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _partial_task(p: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            code, sets = _keys(t)
            h = t.column("h").to_numpy().view(np.uint64)
            packed, samples = _reduce(code, *register_values(h, p), code, h, sets.num_rows, p, k)
            yield from pa.table([sets.column("kind"), sets.column("set"), pa.array(packed, pa.binary()), _lists(samples)], names=["kind", "set", "registers", "sample"]).to_batches()

    return run


def _merge_task(p: int, k: int):
    """Rows in order of their sets; a set goes on from batch to batch as one merged sketch."""

    def merged(t: pa.Table) -> pa.Table:
        code, sets = _keys(t)
        parts = [_entries(raw, p) for raw in t.column("registers").to_pylist()]
        owner = np.repeat(code, [len(a) for a, _ in parts])
        samples = t.column("sample").combine_chunks()
        h = samples.flatten().to_numpy().view(np.uint64)
        by = np.repeat(code, samples.value_lengths().to_numpy())
        packed, kept = _reduce(owner, np.concatenate([a for a, _ in parts]), np.concatenate([r for _, r in parts]), by, h, sets.num_rows, p, k)
        return pa.table([sets.column("kind"), sets.column("set"), pa.array(packed, pa.binary()), _lists(kept)], names=["kind", "set", "registers", "sample"])

    def finished(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = t.column("sample").combine_chunks().value_lengths().to_numpy()
        n = [float(s) if s < k else set_size(unpack(raw, p)) for s, raw in zip(sizes, t.column("registers").to_pylist(), strict=True)]
        out = pa.table([t.column("kind"), t.column("set"), pa.array(n, pa.float64()), pa.array(sizes < k), t.column("registers"), t.column("sample")], names=["kind", "set", "n", "whole", "registers", "sample"])
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # bounds what is unpacked at once
                t = pa.Table.from_batches([batch.slice(at, 1024)]).select(["kind", "set", "registers", "sample"])
                names = t.schema.names
                if kept is not None:
                    t = pa.concat_tables([kept, t.cast(kept.schema)])
                tail = tuple(t.column(c)[-1].as_py() for c in ("kind", "set"))
                t = merged(t).select(names)
                last = next(i for i in range(t.num_rows) if (t.column("kind")[i].as_py(), t.column("set")[i].as_py()) == tail)
                kept = t.slice(last, 1).combine_chunks()
                if t.num_rows > 1:
                    yield from finished(pa.concat_tables([t.slice(0, last), t.slice(last + 1)]))
        if kept is not None:
            yield from finished(kept)

    return run


def hashed_members(members: DataFrame) -> DataFrame:
    """(kind, set, h) without nulls; repeated rows stay. The kind is part of the hash, so that it alone tells members apart."""
    return present(members.select("kind", "set", "member")).select(F.col("kind").cast("string").alias("kind"), F.col("set").cast("string").alias("set"), F.xxhash64("kind", "member").alias("h"))


def sketch_sets(hashed: DataFrame, p: int = PRECISION, k: int = SAMPLE) -> DataFrame:
    """One sketch per set: n (members; exact where ``whole``), registers and the sampled hashes. Partial sketches are all that is shuffled."""
    partial = hashed.mapInArrow(_partial_task(p, k), "kind STRING, set STRING, registers BINARY, sample ARRAY<BIGINT>")
    return partial.repartition("kind", "set").sortWithinPartitions("kind", "set").mapInArrow(_merge_task(p, k), _SKETCH)


def _log_likelihood(theta: np.ndarray, ka: np.ndarray, kb: np.ndarray, cnt: np.ndarray, m: float, top: int) -> np.ndarray:
    """Poisson log likelihoods of register pairs, one for each row of theta: log sizes of only a, only b, both."""
    la, lb, lx = (np.exp(theta) / m).T[:, :, None]

    def cdf(rate: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.where(k < 0, 0.0, np.where(k >= top, 1.0, np.exp(-rate * np.exp2(-np.clip(k, 0, top).astype(float)))))

    lo, hi = np.minimum(ka, kb), np.maximum(ka, kb)
    other = np.where(ka < kb, lb, la)  # rate of what only the set with the larger value holds
    same = np.where(ka < kb, la, lb)
    low = cdf(same + lx, lo) - cdf(same + lx, lo - 1)
    unequal = low * (cdf(other, hi) - cdf(other, hi - 1))
    fa, fb, fx = cdf(la, ka), cdf(lb, kb), cdf(lx, ka)
    fx1 = cdf(lx, ka - 1)
    equal = (fx - fx1) * fa * fb + fx1 * (fa - cdf(la, ka - 1)) * (fb - cdf(lb, kb - 1))
    return np.log(np.maximum(np.where(ka == kb, equal, unequal), 1e-300)) @ cnt


def joint_estimate(ka: np.ndarray, kb: np.ndarray, cnt: np.ndarray, p: int, matched: float = 0.0, sampled: float = 0.0) -> tuple[float, float, float, float]:
    """(only a, only b, both, standard error of both): maximum of the joint likelihood of register pairs and of ``matched`` of ``sampled`` members of a.

    Damped Newton steps on the logarithms, derivatives from one batch of evaluations. As a sample is drawn without
    replacement, it weighs the more the more of its set it holds.
    """
    m, top = float(2**p), 65 - p
    cnt = cnt.astype(float)
    size = lambda k: m * np.log(m / max(m - cnt[k > 0].sum(), 1.0))
    na, nb = max(size(ka), sampled, 1.0), max(size(kb), 1.0)
    weight = 1.0 / max(1.0 - sampled / (na + 1.0), 1e-3)
    first = matched / sampled * na if sampled else cnt[(ka == kb) & (ka > 0)].sum()
    x0 = min(max(first, 0.5), 0.999 * min(na, nb))
    theta = np.log([max(na - x0, 0.5), max(nb - x0, 0.5), x0])

    def f(t: np.ndarray) -> np.ndarray:
        whole = np.logaddexp(t[:, 0], t[:, 2])
        return _log_likelihood(t, ka, kb, cnt, m, top) + weight * (matched * (t[:, 2] - whole) + (sampled - matched) * (t[:, 0] - whole))

    h = 1e-3
    eye = np.eye(3) * h
    corners = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    around = np.array([np.zeros(3), *eye, *-eye, *[a * eye[i] + b * eye[j] for i, j in corners for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]])
    halves = 0.5 ** np.arange(12)[:, None]
    hess = -np.eye(3)
    for _ in range(60):
        v = f(theta + around)
        up, down = v[1:4], v[4:7]
        g = (up - down) / (2 * h)
        hess = np.diag((up - 2 * v[0] + down) / (h * h))
        for (i, j), c in zip(corners, v[7:].reshape(3, 4), strict=True):
            hess[i, j] = hess[j, i] = (c[0] - c[1] - c[2] + c[3]) / (4 * h * h)
        w, q = np.linalg.eigh(hess)
        step = q @ ((q.T @ g) / np.maximum(np.abs(w), 1e-6))
        step *= min(1.0, 1.5 / max(np.abs(step).max(), 1e-12))
        tried = f(theta + halves * step)
        i = int(tried.argmax())
        gain = tried[i] - v[0]
        if gain <= 0:
            break
        theta = theta + halves[i] * step
        if gain < 1e-7 or np.abs(halves[i] * step).max() < 1e-6:
            break
    a, b, x = np.exp(theta)
    w, q = np.linalg.eigh(-hess)
    spread = float(np.sqrt((q[2] ** 2 / np.maximum(w, 1e-6)).sum()))
    return float(a), float(b), float(x), float(min(x * spread, min(a, b) + x))


def _estimate_task(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 65 - p
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                c = {n: batch.column(n)[r].as_py() for n in ("n_small", "n_large", "whole", "matched", "sampled", "of_small", "of_large")}
                if c["whole"]:
                    rows.append((c["n_small"] - c["matched"], max(c["n_large"] - c["matched"], 0.0), float(c["matched"]), 0.0))
                    continue
                cells = np.bincount(unpack(c["of_small"], p).astype(np.int64) * (top + 1) + unpack(c["of_large"], p), minlength=(top + 1) ** 2)
                seen = np.flatnonzero(cells)
                rows.append(joint_estimate(seen // (top + 1), seen % (top + 1), cells[seen], p, float(c["matched"]), float(c["sampled"])))
            est = np.array(rows, dtype=float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("kind", "small", "large", "n_small", "n_large")], *[pa.array(est[:, i]) for i in range(4)]], names=["kind", "small", "large", "n_small", "n_large", "only_small", "only_large", "shared", "shared_error"])

    return run


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    g = _mix(~h)
    return (g & np.uint64(bits - 1)).astype(np.int64), ((g >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap_task(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.zeros(bits, dtype=bool)
        for batch in batches:
            for at in _probes(batch.column("sample").flatten().to_numpy().view(np.uint64), bits):
                taken[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(taken).tobytes()], pa.binary())], names=["bits"])

    return run


def _joined_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = None
    for batch in batches:
        for raw in batch.column("bits"):
            taken = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
            out = taken.copy() if out is None else np.bitwise_or(out, taken, out=out)
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])


def sampled_bitmap(sketches: DataFrame) -> tuple[bytes, int]:
    """Two bits for each sampled member, 16 bits of room each up to ``BITMAP_BITS`` (16 MB); beyond that more rows pass, none is lost."""
    n = sketches.agg(F.sum(F.size("sample"))).first()[0] or 0
    bits = min(BITMAP_BITS, max(1 << 16, 1 << int(16 * n).bit_length()))
    # At most eight maps meet in one task; one comes to the driver.
    maps = sketches.select("sample").coalesce(8).mapInArrow(_bitmap_task(bits), "bits BINARY").repartition(1).mapInArrow(_joined_task, "bits BINARY")
    row = maps.first()
    return (bytes(row["bits"]) if row else bytes(bits // 8)), bits


def _sampled_task(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for at in _probes(batch.column("h").to_numpy().view(np.uint64), bits):
                keep &= (taken[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def candidate_pairs(hashed: DataFrame, sketches: DataFrame, min_share: float, min_size: float) -> DataFrame:
    """Pairs (kind, small, large) that may share ``min_share`` of the smaller set, with ``matched`` of ``sampled`` of its members found in the larger one; both inputs must be materialized.

    Members meet as hashes and numbers of sets; names come back when the pairs are known.
    """
    spark: SparkSession = hashed.sparkSession
    large_enough = sketches.where(F.col("n") >= min_size)
    raw, bits = sampled_bitmap(large_enough)
    sets = sized_broadcast(large_enough.select("kind", "set", F.col("id").alias("large"), F.col("n").alias("n_large")))
    near = hashed.mapInArrow(_sampled_task(spark.sparkContext.broadcast(raw), bits), "kind STRING, set STRING, h BIGINT")
    # Partitioned as the join needs it before repeated rows are dropped: moved once.
    near = near.join(sets, ["kind", "set"]).select("h", "large", "n_large").repartition("h").distinct()
    samples = large_enough.select(F.col("id").alias("small"), F.col("n").alias("n_small"), F.explode("sample").alias("h"))
    met = samples.join(near, "h").where("n_small < n_large OR n_small = n_large AND small < large")
    pairs = met.groupBy("small", "large").agg(F.count(F.lit(1)).alias("matched"))
    names = large_enough.select("kind", F.col("set").alias("small_set"), F.col("id").alias("small"), F.col("n").alias("n_small"), "whole", F.size("sample").alias("sampled"))
    below = F.when(F.col("whole"), F.lit(0.0)).otherwise(SEARCH_ERRORS * F.sqrt(F.col("sampled") * F.lit(min_share * (1 - min_share))) + 1.0)
    pairs = pairs.join(sized_broadcast(names), "small").where(F.col("matched") >= min_share * F.col("sampled") - below - 1e-9)
    others = sized_broadcast(large_enough.select(F.col("set").alias("large_set"), F.col("id").alias("large"), F.col("n").alias("n_large")))
    return pairs.join(others, "large").select("kind", F.col("small_set").alias("small"), F.col("large_set").alias("large"), "n_small", "n_large", "whole", "matched", "sampled")


def exact_parts(hashed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The listed pairs (kind, small, large) with exact n_small, n_large and shared; only their sets' members are moved."""
    names = sized_broadcast(materialize(pairs.select("kind", F.explode(F.array("small", "large")).alias("set")).distinct(), "doubtful-sets"))
    rows = materialize(hashed.join(names, ["kind", "set"], "left_semi").distinct(), "doubtful-members")
    sizes = materialize(rows.groupBy("kind", "set").agg(F.count(F.lit(1)).cast("double").alias("n")), "exact-sizes")
    mine = rows.withColumnRenamed("set", "small").join(sized_broadcast(pairs.select("kind", "small", "large")), ["kind", "small"])
    met = mine.join(rows.withColumnRenamed("set", "large"), ["kind", "large", "h"]).groupBy("kind", "small", "large").agg(F.count(F.lit(1)).cast("double").alias("shared"))
    for side in ("small", "large"):
        met = met.join(sized_broadcast(sizes.withColumnsRenamed({"set": side, "n": f"n_{side}"})), ["kind", side])
    return met.select("kind", "small", "large", "n_small", "n_large", (F.col("n_small") - F.col("shared")).alias("only_small"), (F.col("n_large") - F.col("shared")).alias("only_large"), "shared", F.lit(0.0).alias("shared_error"))


def sample_size(min_share: float) -> int:
    """Members a sample must hold so that ``SEARCH_ERRORS`` standard errors are at most six tenths of the matches looked for: else nearly every pair that shares anything would have to be estimated."""
    needed = (SEARCH_ERRORS / 0.6) ** 2 * (1 - min_share) / min_share
    return max(SAMPLE, 1 << (max(int(needed), 1) - 1).bit_length())


def overlap_sizes(members: DataFrame, min_share: float, min_size: float = 1.0, p: int = PRECISION, k: int | None = None) -> DataFrame:
    """Pairs of sets of the same kind that share at least ``min_share`` (> 0) of the smaller one, with the estimated parts.

    Input columns kind, set, member; result kind, set_a < set_b (byte order), n_a, n_b, only_a, only_b, shared, shared_error
    (standard error; 0 where shared is exact), share. Sets of fewer than ``min_size`` members are left out. Null kinds, sets
    and members are left out, repeated rows change nothing; an empty input, or sets that share nothing, give no row. ``k`` is
    the size of the samples (by default :func:`sample_size`).
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1: all pairs would have to be compared otherwise")
    k = k or sample_size(min_share)
    hashed = materialize(hashed_members(members), "hashed-members")
    sketches = materialize(sketch_sets(hashed, p, k).withColumn("id", F.monotonically_increasing_id()), "set-sketches")
    pairs = materialize(candidate_pairs(hashed, sketches, min_share, min_size), "pairs")
    listed = sized_broadcast(pairs)
    packed = sketches.select("kind", "set", "registers")
    of_small = packed.withColumnsRenamed({"set": "small", "registers": "of_small"}).join(listed, ["kind", "small"])
    needed = sized_broadcast(pairs.select("kind", F.col("large").alias("set")).distinct())
    of_large = packed.join(needed, ["kind", "set"], "left_semi").withColumnsRenamed({"set": "large", "registers": "of_large"})
    est = of_small.join(of_large, ["kind", "large"]).mapInArrow(_estimate_task(p), "kind STRING, small STRING, large STRING, n_small DOUBLE, n_large DOUBLE, only_small DOUBLE, only_large DOUBLE, shared DOUBLE, shared_error DOUBLE")
    est = materialize(est, "estimates")
    unsure = F.abs(F.col("shared") - min_share * F.col("n_small")) < DOUBT_ERRORS * F.col("shared_error")
    doubtful = est.where(unsure).select("kind", "small", "large")
    if not doubtful.isEmpty():
        est = est.where(~unsure).unionByName(exact_parts(hashed, doubtful))
    est = est.withColumn("share", F.col("shared") / F.col("n_small")).where(F.col("share") >= min_share - 1e-12)
    swap = F.col("small") > F.col("large")
    turned = [F.when(swap, F.col(f"{c}_large")).otherwise(F.col(f"{c}_small")).alias(f"{c}_a") for c in ("n", "only")] + [F.when(swap, F.col(f"{c}_small")).otherwise(F.col(f"{c}_large")).alias(f"{c}_b") for c in ("n", "only")]
    out = est.select("kind", F.least("small", "large").alias("set_a"), F.greatest("small", "large").alias("set_b"), *turned, "shared", "shared_error", "share")
    return out.select("kind", "set_a", "set_b", "n_a", "n_b", "only_a", "only_b", "shared", "shared_error", "share")


def shared_counts(members: DataFrame) -> DataFrame:
    """Every pair of sets of the same kind that shares at least one member, with exact numbers.

    Input and result columns as of :func:`overlap_sizes`, the numbers as BIGINT. Sets of any size take part; null kinds, sets and
    members are left out, repeated rows change nothing. A member of f sets costs f (f + 1) / 2 numbers, added up in each task before the shuffle.
    """
    once = present(members.select("kind", "set", "member")).distinct()
    sets = once.groupBy("kind", "member").agg(F.sort_array(F.collect_list("set")).alias("sets"))
    firsts = sets.select("kind", "sets", F.posexplode("sets").alias("at", "set_a"))
    # A set with itself comes too: its number is the size of the set.
    met = firsts.select("kind", "set_a", F.explode(F.slice("sets", F.col("at") + 1, F.size("sets"))).alias("set_b"))
    counts = materialize(met.groupBy("kind", "set_a", "set_b").agg(F.count(F.lit(1)).alias("shared")), "shared-counts")
    sizes = sized_broadcast(counts.where("set_a = set_b").select("kind", F.col("set_a").alias("set"), F.col("shared").alias("n")))
    pairs = counts.where("set_a < set_b")
    for side in ("a", "b"):
        pairs = pairs.join(sizes.withColumnsRenamed({"set": f"set_{side}", "n": f"n_{side}"}), ["kind", f"set_{side}"])
    return pairs.select("kind", "set_a", "set_b", "n_a", "n_b", (F.col("n_a") - F.col("shared")).alias("only_a"), (F.col("n_b") - F.col("shared")).alias("only_b"), "shared", (F.col("shared") / F.least("n_a", "n_b")).alias("share"))
