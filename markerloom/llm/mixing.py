"""A mix of sources with target shares of the tokens.

Documents of a source stand in the order of a seeded hash of their id. That order is cut into ranges of the hash (a range
sort, as hash values are spread evenly), a prefix sum over the ranges' token totals and one within each range give every
document its position in tokens, and the source is cut at what its budget leaves after whole repetitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, sized_broadcast
from .tokens import DEFAULT_VOCABULARY, token_counts

#: Rows of one hash range, on average over all sources.
ROWS_PER_RANGE = 20_000


def source_plan(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target source: its tokens, its budget (target share of all tokens), whole repetitions, and the tokens of one more that are left to cut."""
    everything = totals.select(F.sum("tokens")).scalar()
    have = totals.where("source IS NOT NULL").select("source", "tokens")
    plan = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").join(have, "source", "left")
    plan = plan.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("source_tokens"), (F.col("target_share") * F.coalesce(everything, F.lit(0)).cast("double")).alias("budget"))
    whole = F.least(F.floor(F.coalesce(F.try_divide(F.col("budget"), F.col("source_tokens").cast("double")), F.lit(0.0))), F.col("max_repeats")).cast("int")
    plan = plan.withColumn("whole", whole)
    rest = F.when(F.col("whole") < F.col("max_repeats"), F.col("budget") - F.col("whole") * F.col("source_tokens")).otherwise(F.lit(0.0))
    return plan.withColumn("rest", rest)


def measure(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Token counts (doc_id, source, tokens) of all documents, measured once and written."""
    return materialize(token_counts(docs, ["doc_id", "source"], "text", vocabulary), "token-counts")


def mix(counted: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Documents of the mix: source, doc_id, tokens, epoch (0-based), mix_key, by which the mix is shuffled.

    ``counted``: doc_id, source, tokens (see :func:`measure`). A source is taken whole ``floor(budget / tokens)`` times and
    then cut where its running total comes closest to the rest of its budget; no document occurs more than ``max_repeats``
    times. Documents without source or with a source without target are left out, but count in the total. Documents of 0
    tokens come with every whole repetition. A repeated row is a document of its own.
    """
    totals = materialize(counted.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("c")), "source-totals")
    plan = sized_broadcast(materialize(source_plan(totals, targets), "source-plan"))
    rows = totals.agg(F.sum("c")).first()[0] or 0
    ranges = max(1, -(-rows // ROWS_PER_RANGE))
    key = F.xxhash64("doc_id", F.lit(seed))
    keyed = counted.where("source IS NOT NULL").select("source", "doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), key.alias("key"))
    # The upper bits of the key name the range; ranges are in the order of their keys.
    keyed = keyed.withColumn("range", F.floor((F.shiftrightunsigned("key", 32).cast("double")) * ranges / 2**32).cast("int")).withColumn("key", F.shiftrightunsigned("key", 1))
    sums = materialize(keyed.groupBy("source", "range").agg(F.sum("tokens").alias("range_tokens")), "range-totals")
    before = F.coalesce(F.sum("range_tokens").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("source", "range", before.alias("range_start"))
    inner = F.sum("tokens").over(W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = keyed.withColumn("upto", inner).join(starts, ["source", "range"]).withColumn("upto", F.col("upto") + F.col("range_start"))
    placed = placed.join(plan, "source")
    # The document at the cut is taken if the total then misses the budget by less.
    partly = (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")) & (F.col("tokens") > 0) & (F.col("rest") > 0)
    times = F.col("whole") + F.when(partly, 1).otherwise(0)
    taken = placed.withColumn("times", times).where("times > 0")
    out = taken.select("source", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
    return out.withColumn("mix_key", F.xxhash64("doc_id", "epoch", F.lit(seed)))


def mix_report(counted: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """For each target source the tokens it has and brings, its target share, its share of the wanted total and of the mix, and whether it falls ``short``.

    A source falls short if all its documents, ``max_repeats`` times each, hold fewer tokens than its budget.
    """
    totals = materialize(counted.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("c")), "source-totals")
    plan = materialize(source_plan(totals, targets), "source-plan")
    got = mix(counted, targets, seed).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").cast("bigint").alias("mix_tokens"), F.max("epoch").alias("last_epoch"))
    got = materialize(got, "mix-totals")
    all_mixed = got.select(F.sum("mix_tokens")).scalar()
    joined = plan.join(got, "source", "left")
    mixed = F.coalesce("mix_tokens", F.lit(0))
    return joined.select(
        "source", "target_share", "max_repeats", "source_tokens", F.round("budget", 3).alias("budget_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), mixed.alias("mix_tokens"),
        F.coalesce(F.col("last_epoch") + 1, F.lit(0)).alias("epochs"), F.coalesce(F.try_divide(mixed * F.col("target_share"), F.col("budget")), F.lit(0.0)).alias("reached_share"),
        F.coalesce(F.try_divide(mixed.cast("double"), all_mixed.cast("double")), F.lit(0.0)).alias("mix_share"), (F.col("max_repeats") * F.col("source_tokens") < F.col("budget")).alias("short"),
    )
