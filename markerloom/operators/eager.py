"""Aggregation through a join without ever shuffling raw rows of a crowded key.

Both inputs are first reduced to one compact state for each key (a count, and a sum with its non-null count for each
measure). Map-side combining turns a key that holds a third of all rows into at most one state per task, so tasks stay
evenly loaded however crowded a key is. The states are joined; a joined group stands for ``n_left * n_right`` rows, a sum
of one side is multiplied by the other side's count, and the products are rolled up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import present

WIDE = "decimal(38,0)"


def key_state(df: DataFrame, keys: dict[str, Column | str], measures: dict[str, Column | str], count: str = "n") -> DataFrame:
    """One row per distinct ``keys``: ``count`` rows, and ``<m>_sum`` with ``<m>_cnt`` (non-null values) of each measure.

    Only the named expressions are read, so further columns, whatever they are called, play no part. Null keys form a
    group of their own; an empty input gives an empty result; nulls in a measure count in ``count`` but not in ``<m>_cnt``.
    """
    col = lambda x: F.col(x) if isinstance(x, str) else x
    slim = df.select(*[col(v).alias(f"k_{k}") for k, v in keys.items()], *[col(v).alias(f"m_{m}") for m, v in measures.items()])
    aggs = [F.count(F.lit(1)).alias(count)]
    for m in measures:
        aggs += [F.sum(F.col(f"m_{m}").cast(WIDE)).alias(f"{m}_sum"), F.count(f"m_{m}").alias(f"{m}_cnt")]
    return slim.groupBy(*[F.col(f"k_{k}").alias(k) for k in keys]).agg(*aggs)


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: dict[str, tuple], left_group: dict, right_group: dict, left_measures: dict, right_measures: dict | None = None) -> DataFrame:
    """``left JOIN right ON keys GROUP BY groups`` as: state of each side, join of states, algebraic roll-up.

    ``on`` maps a key name to its expression on either side. The result has the group columns, ``n_rows`` (rows the
    plain join would have) and for every measure ``<m>_sum`` and ``<m>_cnt`` over those rows. As in any inner join a
    null key matches nothing; null group values form a group; duplicates multiply as they would in the plain join.
    """
    right_measures = right_measures or {}
    a = key_state(left, {**{k: v[0] for k, v in on.items()}, **left_group}, left_measures, "n_l")
    b = key_state(right, {**{k: v[1] for k, v in on.items()}, **right_group}, right_measures, "n_r")
    joined = present(a, *on).join(present(b, *on), list(on))
    n_l, n_r = F.col("n_l").cast(WIDE), F.col("n_r").cast(WIDE)
    aggs = [F.sum((n_l * n_r).cast(WIDE)).cast("bigint").alias("n_rows")]
    for names, other in ((left_measures, n_r), (right_measures, n_l)):
        for m in names:
            aggs += [F.sum((F.col(f"{m}_sum") * other).cast(WIDE)).cast("bigint").alias(f"{m}_sum"), F.sum((F.col(f"{m}_cnt").cast(WIDE) * other).cast(WIDE)).cast("bigint").alias(f"{m}_cnt")]
    return joined.groupBy(*left_group, *right_group).agg(*aggs)


def crowded_key_profile(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_measures: dict, min_share: float, names: Sequence[str] = ("left", "right"), missing: str = "") -> DataFrame:
    """Per key: rows and share on either side, the rows of their join, sums of the left measures alone and through the join.

    Rows without a key are counted together under ``missing``; they match nothing, so their ``n_join`` is 0. A side is
    flagged ``crowded_<name>`` where a key holds at least ``min_share`` of its rows. Shares refer to all rows of the side,
    repeated rows included. With an empty side its share is null and no key is crowded there.
    """
    l_name, r_name = names
    a = key_state(left, {"key": F.coalesce(left_key, F.lit(missing))}, left_measures, f"n_{l_name}")
    b = key_state(right, {"key": F.coalesce(right_key, F.lit(missing))}, {}, f"n_{r_name}")
    n_a, n_b = F.coalesce(f"n_{l_name}", F.lit(0)), F.coalesce(f"n_{r_name}", F.lit(0))
    both = a.join(b, "key", "full_outer")
    out = [F.col("key"), n_a.cast("bigint").alias(f"n_{l_name}"), n_b.cast("bigint").alias(f"n_{r_name}")]
    matches = F.when(F.col("key") == missing, F.lit(0)).otherwise(n_b)
    out.append((n_a.cast(WIDE) * matches.cast(WIDE)).cast("bigint").alias("n_join"))
    for m in left_measures:
        out += [F.col(f"{m}_sum").cast("bigint").alias(f"{m}_sum"), F.coalesce(f"{m}_cnt", F.lit(0)).cast("bigint").alias(f"{m}_cnt"), F.round(F.try_divide(F.col(f"{m}_sum").cast("double"), F.col(f"{m}_cnt")), 6).alias(f"{m}_mean"), (F.col(f"{m}_sum") * matches.cast(WIDE)).cast("bigint").alias(f"{m}_join_sum")]
    states = both.select(*out)
    for name, state in ((l_name, a), (r_name, b)):
        total = state.select(F.sum(f"n_{name}")).scalar()  # one number, over the compact states
        states = states.withColumn(f"share_{name}", F.try_divide(F.col(f"n_{name}").cast("double"), total.cast("double"))).withColumn(f"crowded_{name}", F.coalesce(F.col(f"share_{name}") >= min_share, F.lit(False)))
    return states


def crowded_keys(profile: DataFrame, tables: dict[str, str], key_alias: str) -> DataFrame:
    """The flagged keys of a :func:`crowded_key_profile` as (ref_table, key), each once."""
    return profile.select("key", F.explode(F.array_compact(F.array(*[F.when(F.col(f"crowded_{short}"), F.lit(full)) for short, full in tables.items()]))).alias("ref_table")).select("ref_table", F.col("key").alias(key_alias))
