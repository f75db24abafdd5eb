"""Filling containers of fixed capacity with whole documents, by windows of several sizes.

Documents are routed to tiers of halving window size: a document belongs to the shortest window that holds it. Every tier is
packed into windows of its own size, from the longest tier on: each window takes documents of its tier, and what gap they leave is
filled from the shorter tiers, longest fitting length first. Windows that stay too empty, because no short documents are left, are
broken up from the shortest tier on, and their documents packed anew in windows of the next longer tier, at last in whole
containers. A container is one window of the longest tier, two of the next, four of the one after, and so on; the windows of
all tiers lie side by side, so at most the last container is not made of full windows.

The plan is made from nothing but the number of documents of each length (at most ``capacity`` numbers, however many documents
there are); equal windows are planned as one pattern with a count. The documents then find their place by their rank among those
of the same length, which is computed in salted parts, so that a length that a third of all documents have is spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import DEFAULT_VOCABULARY, token_counts

#: Tiers: windows of capacity, capacity / 2, ... capacity / 2**(TIERS - 1).
TIERS = 6
#: A window of a shorter tier that is less full is broken up in favour of a longer one.
LEAST_FILL = 0.995
#: Parts in which documents of one length are ranked.
SALTS = 32
#: Containers of one step group.
STEP_SIZE = 64


@dataclass(frozen=True)
class Plan:
    """Runs of equal slots, ordered by (size, first rank): ``per`` documents of the size go into each window of the run."""

    sizes: np.ndarray  # lengths, ascending
    before: np.ndarray  # documents of shorter lengths
    key: np.ndarray  # documents before the run, over all lengths
    per: np.ndarray
    unit: np.ndarray  # place of the run's first window, in windows of the shortest tier
    tier: np.ndarray
    tiers: int
    containers: int
    used: int  # tokens

    def window(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First unit and tier of the window of each document, given by length and rank."""
        at = self.before[np.searchsorted(self.sizes, size)] + rank
        run = np.searchsorted(self.key, at, side="right") - 1
        return self.unit[run] + ((at - self.key[run]) // self.per[run] << (self.tiers - 1 - self.tier[run])), self.tier[run]

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and window tier of each document."""
        unit, tier = self.window(size, rank)
        return unit >> (self.tiers - 1), tier


def tier_of(size: int, capacity: int, tiers: int = TIERS) -> int:
    """0 for the longest window; a length belongs to the shortest window that holds it."""
    t = 0
    while t < tiers - 1 and size <= capacity >> (t + 1):
        t += 1
    return t


Pattern = list[tuple[int, int]]


def _fill_windows(window: int, own: list[int], shorter: list[list[int]], left: dict[int, int]) -> list[tuple[Pattern, int]]:
    """Windows for all documents of the lengths ``own`` (ascending), gaps filled from own and ``shorter`` lengths: (documents of each length in a window, number of windows). Uses up ``left`` and the lists."""
    out = []
    while own:
        gap, pattern = window, []
        for pool in (own, *shorter):
            upto = len(pool)
            while upto and gap:
                upto = bisect_right(pool, gap, 0, upto)
                if not upto:
                    break
                upto -= 1
                k = min(gap // pool[upto], left[pool[upto]])
                pattern.append((pool[upto], k))
                gap -= pool[upto] * k
        times = min(left[s] // k for s, k in pattern)
        out.append((pattern, times))
        for s, k in pattern:
            left[s] -= k * times
            if not left[s]:
                next(p for p in (own, *shorter) if (i := bisect_right(p, s)) and p[i - 1] == s).remove(s)
    return out


def plan_containers(histogram: dict[int, int], capacity: int, tiers: int = TIERS) -> Plan:
    """``histogram``: number of documents for each length from 1 to ``capacity``."""
    counts = {int(s): int(c) for s, c in histogram.items() if c > 0}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    tiers = max(1, min(tiers, capacity.bit_length()))
    left = dict(counts)
    pools: list[list[int]] = [[] for _ in range(tiers)]
    for s in left:
        insort(pools[tier_of(s, capacity, tiers)], s)
    windows: list[list[tuple[Pattern, int]]] = [_fill_windows(capacity >> t, pools[t], pools[t + 1 :], left) for t in range(tiers)]
    for t in range(tiers - 1, 0, -1):
        size = capacity >> t
        full = [w for w in windows[t] if sum(s * k for s, k in w[0]) >= LEAST_FILL * size]
        spare: dict[int, int] = {}
        for pattern, times in windows[t]:
            if sum(s * k for s, k in pattern) < LEAST_FILL * size:
                for s, k in pattern:
                    spare[s] = spare.get(s, 0) + k * times
        windows[t] = full
        windows[t - 1] += _fill_windows(capacity >> (t - 1), sorted(spare), [], spare)
    runs, next_rank, unit, used = [], dict.fromkeys(counts, 0), 0, 0
    for t, own in enumerate(windows):
        # Windows of like cost lie side by side, so that dealing containers out in turn balances the step groups.
        own.sort(key=lambda x: (-sum(s * s * k for s, k in x[0]), x[0]))
        for pattern, times in own:
            for s, k in pattern:
                runs.append((s, next_rank[s], k, unit, t))
                next_rank[s] += k * times
                used += s * k * times
            unit += times << (tiers - 1 - t)
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    sizes = np.array(sorted(counts), dtype=np.int64)
    before = np.r_[0, np.cumsum([counts[s] for s in sizes.tolist()])].astype(np.int64)[:-1]
    key = before[np.searchsorted(sizes, table[:, 0])] + table[:, 1] if len(table) else table[:, 1]
    return Plan(sizes, before, key, table[:, 2].copy(), table[:, 3].copy(), table[:, 4].copy(), tiers, -(-unit >> (tiers - 1)), used)


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """Rows (doc_id, piece, token_from, tokens): a document of more than ``capacity`` tokens in pieces of ``capacity`` and one of the rest, any other whole as piece 0."""
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    split = counts.select("doc_id", F.col("tokens").alias("all_tokens"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return split.select("doc_id", "piece", start.alias("token_from"), F.least(F.col("all_tokens") - start, F.lit(capacity)).cast("bigint").alias("tokens"))


def _place_task(plan: Plan, capacity: int, tiers: int, step_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = max(1, -(-plan.containers // step_size))
        bounds = np.array([capacity >> (t + 1) for t in range(tiers - 1)], dtype=np.int64)
        for batch in batches:
            size = batch.column("tokens").to_numpy()
            at, window = plan.place(size, batch.column("rank").to_numpy())
            tier = (size[:, None] <= bounds[None, :]).sum(axis=1)
            lap, pos = at // groups, at % groups
            step = np.where(lap % 2 == 0, pos, groups - 1 - pos)  # there and back, so that no group gets the costlier one each time
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "token_from", "tokens")], pa.array(tier.astype(np.int32)), pa.array(window.astype(np.int32)), pa.array(at), pa.array(step)], names=["doc_id", "piece", "token_from", "tokens", "tier", "window_tier", "container_id", "step_group"])

    return run


def pack(docs: DataFrame, capacity: int, vocabulary: str = DEFAULT_VOCABULARY, tiers: int = TIERS, step_size: int = STEP_SIZE) -> DataFrame:
    """Every document's container: doc_id, piece, token_from, tokens, tier (of its length), window_tier (of the window it lies in), container_id (0-based), step_group.

    A document is cut only if it alone exceeds ``capacity``. Null and empty texts take no room: they come out with 0
    tokens and null in both tiers, container and group. Every input row is a document, also a repeated one. Only doc_id and
    text are read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    part = pieces(token_counts(docs, ["doc_id"], "text", vocabulary), capacity)
    part = materialize(part.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "pieces")
    solid = part.where("tokens > 0")
    per_salt = materialize(solid.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("c")), "lengths")
    # At most ``capacity`` rows come to the driver.
    histogram = {r["tokens"]: r["c"] for r in per_salt.groupBy("tokens").agg(F.sum("c").alias("c")).toLocalIterator()}
    plan = plan_containers(histogram, capacity, tiers)
    before = F.sum("c").over(W.partitionBy("tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    # Merged on the keys the ranks are partitioned by already: nothing is broadcast and no row is moved again.
    starts = per_salt.select("tokens", "salt", F.coalesce(before, F.lit(0)).alias("start")).hint("merge")
    local = F.row_number().over(W.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = solid.withColumn("local", local).join(starts, ["tokens", "salt"]).select("doc_id", "piece", "token_from", "tokens", (F.col("start") + F.col("local")).cast("bigint").alias("rank"))
    placed = ranked.mapInArrow(_place_task(plan, capacity, tiers, step_size), "doc_id BIGINT, piece INT, token_from BIGINT, tokens BIGINT, tier INT, window_tier INT, container_id BIGINT, step_group BIGINT")
    void = part.where("tokens = 0").select("doc_id", "piece", "token_from", "tokens", F.lit(None).cast("int").alias("tier"), F.lit(None).cast("int").alias("window_tier"), F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("bigint").alias("step_group"))
    return placed.unionByName(void)


def container_fill(packed: DataFrame, capacity: int) -> DataFrame:
    """Documents, tokens and fill of each container."""
    per = packed.where("container_id IS NOT NULL").groupBy("container_id", "step_group").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("tokens").alias("tokens"))
    return per.withColumn("fill", F.round(F.col("tokens") / capacity, 6))


def cut_documents(packed: DataFrame) -> DataFrame:
    """Documents that exceed the capacity alone: those of which a second piece was packed."""
    return packed.where("piece = 1").select("doc_id").distinct()
