"""The N best items of every group by simultaneous search for all groups' cutoffs.

Score and identifier become one order-preserving BIGINT code, so ties are decided once and for all. Each round splits the
range that still holds a group's cutoff into ``fanout`` slices and counts the rows of every slice, for all groups in one
aggregation (``fanout = 2`` is plain bisection); the slice in which the N-th row lies is the next range. The first round has one
range for all groups and joins nothing; a later round reads only the rows that lay within their group's range the round before,
so the rows shrink as the ranges do, and a range of no more rows than slices is told apart row by row. No group is ever sorted or gathered: a task holds counts, and what is ranked at the end is
N rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, present, sized_broadcast

CODE_BITS = 62
#: Where cutoffs are too many to broadcast, groups that hold more than a quarter of a task's share of the rows are joined in this many parts.
SALTS = 16


def _dense_order(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values with their 0-based position in ascending byte order, by a range sort and one count per partition."""
    values = materialize(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id()), "ordered")
    counts = values.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # a row per partition
    starts = counts.withColumn("start", F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", F.coalesce("start", F.lit(0)).alias("start"))
    local = F.row_number().over(W.partitionBy("part").orderBy(column))
    return values.join(F.broadcast(starts), "part").select(column, (F.col("start") + local - 1).alias("pos"))


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's columns of ``cutoffs``, of which ``size``, the rows of the group, is used up here."""
    slim = cutoffs.drop("size")
    small = sized_broadcast(slim)
    if small is not slim:
        return rows.join(small, keys)
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = (cutoffs.agg(F.sum("size")).first()[0] or 0) / parts
    crowded = F.broadcast(cutoffs.where(F.col("size") > share).select(*keys, F.lit(True).alias("crowded")))  # fewer than ``parts`` groups can hold so much
    salted = slim.join(crowded, keys, "left").withColumn("salt", F.explode(F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("crowded")
    salt = F.when(F.col("crowded"), F.pmod(F.xxhash64("code"), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.join(crowded, keys, "left").withColumn("salt", salt).drop("crowded").join(salted, [*keys, "salt"]).drop("salt")


def encode(df: DataFrame, groups: Sequence[str], item: str, score: str) -> DataFrame:
    """Rows (groups, item, score, code): the best score of each item in its group, and a code that rises with the score and, for equal scores, falls with the item.

    Scores are shifted to start at 0; where their range and the number of items do not fit into 62 bits together, the
    position among the distinct scores takes the place of the score.
    """
    keys = [*groups, item, score]
    if not isinstance(df.schema[score].dataType, T.IntegralType):
        raise ValueError("scores must be whole numbers")
    best = present(df.select(*keys)).groupBy(*groups, item).agg(F.max(F.col(score).cast("bigint")).alias(score))
    best = materialize(best, "best-scores")
    order = materialize(_dense_order(best, item).withColumnRenamed("pos", "item_pos"), "item-order")
    span = best.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    n_items = max(order.agg(F.max("item_pos")).first()[0] or 0, 1)
    item_bits = int(n_items).bit_length()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    coded = best.join(sized_broadcast(order), item)
    if (hi - lo).bit_length() + item_bits <= CODE_BITS:
        level = F.col(score) - F.lit(lo)
    else:
        scores = materialize(_dense_order(best, score).withColumnRenamed("pos", "score_pos"), "score-order")
        coded = coded.join(sized_broadcast(scores), score)
        level = F.col("score_pos")
    return materialize(coded.select(*groups, item, score, (F.shiftleft(level, item_bits) + (F.lit((1 << item_bits) - 1) - F.col("item_pos"))).alias("code")), "codes")


def cutoffs(codes: DataFrame, groups: Sequence[str], n: int, fanout: int = 64) -> DataFrame:
    """For each group its ``cutoff``, the code of its n-th row (of its last one, if it has fewer), and its ``size`` in rows."""
    groups = list(groups)
    every, down = W.partitionBy(*groups), W.partitionBy(*groups).orderBy(F.desc("slice"))  # over at most fanout rows of a group

    def counted(rows: DataFrame, lo: Column, hi: Column, few: Column) -> DataFrame:
        """Rows of every slice; where no more than ``fanout`` rows are left in a range each has a slice of its own."""
        width = F.when(few, F.lit(1)).otherwise(F.floor((hi - lo) / fanout) + 1).cast("bigint")
        slices = rows.groupBy(*groups, F.call_function("div", F.col("code") - lo, width).alias("slice"))
        return slices.agg(F.min("code").alias("s_lo"), F.max("code").alias("s_hi"), F.count(F.lit(1)).alias("c"), F.first("above").alias("above"), F.first("size").alias("size"))

    def next_state(slices: DataFrame) -> DataFrame:
        # lo, hi: range of codes that holds the cutoff, above: rows beyond the range, inside: rows in it.
        ranked = slices.withColumn("upto", F.col("above") + F.sum("c").over(down)).withColumn("size", F.coalesce("size", F.sum("c").over(every)))
        short = F.col("size") <= n  # the group has no n-th row: its last slice is the one
        hit = ranked.where(F.when(short, F.col("upto") == F.col("size")).otherwise((F.col("upto") >= n) & (F.col("upto") - F.col("c") < n)))
        return materialize(hit.select(*groups, F.col("s_lo").alias("lo"), F.when(short, F.col("s_lo")).otherwise(F.col("s_hi")).alias("hi"), F.col("c").alias("inside"), (F.col("upto") - F.col("c")).alias("above"), "size"), "cutoffs")

    ends = codes.agg(F.min("code").alias("lo"), F.max("code").alias("hi")).first()
    zero = F.lit(0).cast("bigint")
    state = next_state(counted(codes.withColumn("above", zero).withColumn("size", F.lit(None).cast("bigint")), F.lit(ends["lo"] or 0), F.lit(ends["hi"] or 0), F.lit(False)))
    rows, found = codes.select(*groups, "code"), None
    while True:
        settled = (F.col("above") + F.col("inside") <= n) | (F.col("lo") == F.col("hi"))
        done = state.where(settled).select(*groups, F.col("lo").alias("cutoff"), "size")
        found = done if found is None else found.unionByName(done)
        open_ = state.where(~settled)
        if open_.isEmpty():
            return found
        ranges = open_.select(*groups, "lo", "hi", "above", (F.col("inside") <= fanout).alias("few"), F.col("size").alias("group_size"), F.col("inside").alias("size"))
        inside = _with_cutoffs(rows, ranges, groups).where("code BETWEEN lo AND hi")
        inside = materialize(inside.withColumnRenamed("group_size", "size"), "open-rows")
        state = next_state(counted(inside, F.col("lo"), F.col("hi"), F.col("few")))
        rows = inside.select(*groups, "code")


def top_n(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int, fanout: int = 64) -> DataFrame:
    """The ``n`` items of each group with the highest score, equal scores by item ascending (byte order), with ``rnk`` 1..n.

    An item that occurs more than once in a group counts once, with its largest score. Rows with a null in a group
    column, the item or the score are left out; groups with fewer items come out whole; an empty input gives no row.
    Only the named columns are read.
    """
    groups = list(groups)
    codes = encode(df, groups, item, score)
    cut = materialize(cutoffs(codes, groups, n, fanout), "found-cutoffs")
    top = _with_cutoffs(codes, cut, groups).where("code >= cutoff")
    return top.withColumn("rnk", F.row_number().over(W.partitionBy(*groups).orderBy(F.desc("code"))).cast("bigint")).select(*groups, item, score, "rnk")
