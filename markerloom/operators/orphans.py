"""References to records that do not exist, or did not exist at the time of the reference.

Always the distinct non-null keys are tested, never the referring rows: a key that a third of all rows name is one row in
the anti join. Only keys found missing are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, present, sized_broadcast


def missing_keys(refs: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct non-null ``keys`` of ``refs`` without a row in ``parents`` (left anti join of key sets)."""
    wanted = present(refs.select(*keys)).distinct()
    return wanted.join(present(parents.select(*keys)).distinct(), list(keys), "left_anti")


def orphan_rows(refs: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``refs`` whose non-null ``keys`` have no row in ``parents``, repeated rows once. Rows with a null key name nothing and are left out."""
    lost = sized_broadcast(materialize(missing_keys(refs, parents, keys), "missing-keys"))
    return refs.join(lost, list(keys), "left_semi").distinct()


def alive_spans(listings: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Disjoint spans (key, span_from, span_to) in which a key is listed; ``span_to`` null means to this day.

    A listing without start never began, one whose end is not after its start never lived. A key open since some time
    needs only its first open start. Closed spans are merged within each key and month and then within each key, so one
    key with a great many listings is spread over its months before any task sees it whole.
    """
    rows = listings.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e")).where("k IS NOT NULL AND s IS NOT NULL")
    opened = rows.where("e IS NULL").groupBy("k").agg(F.min("s").alias("s")).withColumn("e", F.lit(None).cast("timestamp_ntz" if dict(rows.dtypes)["s"] == "timestamp_ntz" else "timestamp"))
    closed = rows.where("e > s").distinct().withColumn("part", F.date_format("s", "yyyy-MM"))

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        order = W.partitionBy(*by).orderBy("s", "e")
        before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
        island = F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
        return df.withColumn("before", before).withColumn("island", island).groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")

    spans = merged(merged(closed, ["k", "part"]).drop("part"), ["k"])
    return spans.select("k", "s", "e").unionByName(opened.select("k", "s", "e")).select(F.col("k").alias(key), F.col("s").alias("span_from"), F.col("e").alias("span_to"))


def orphans_in_time(refs: DataFrame, listings: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Rows of ``refs`` (repeated rows once) whose ``key`` was not listed at time ``at``, with ``status``.

    ``missing``: no listing at all. ``late``: every listing starts after ``at`` (or has no start). ``deleted``: anything
    else. Null keys are left out. A reference without time can only be ``missing``. An empty ``listings`` makes every
    reference missing.
    """
    lost = materialize(missing_keys(refs, listings, [key]), "missing-keys").withColumn("status", F.lit("missing"))
    points = present(refs.select(key, at)).distinct()
    spans = alive_spans(listings, key, start, end)
    inside = (points[key] == spans[key]) & (spans["span_from"] <= points[at]) & (spans["span_to"].isNull() | (spans["span_to"] > points[at]))
    known = listings.select(key, start).where(F.col(key).isNotNull()).groupBy(key).agg(F.min(start).alias("first_start"))
    dead = points.join(spans, inside, "left_anti").join(known, key)
    dead = dead.select(key, at, F.when(F.col("first_start").isNull() | (F.col("first_start") > F.col(at)), F.lit("late")).otherwise(F.lit("deleted")).alias("status"))
    dead = materialize(dead, "dead-references")
    # Repeated rows are removed last, when only orphans are left to move.
    return refs.join(sized_broadcast(lost), key).unionByName(refs.join(sized_broadcast(dead), [key, at])).distinct()


def orphan_counts(orphans: DataFrame, table_col: str = "ref_table", month_col: str = "ref_month") -> DataFrame:
    """Number of orphan references for each table, month and status."""
    return orphans.groupBy(table_col, month_col, "status").agg(F.count(F.lit(1)).alias("n_refs"))
