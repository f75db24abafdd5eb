"""Merging samples into matrices, removing contamination, projecting taxa onto functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def names(value: str | Sequence[str] | None) -> list[str]:
    """A comma-separated or ready list of sample names, trimmed, without empty ones."""
    parts = value.split(",") if isinstance(value, str) else (value or [])
    return [p.strip() for p in parts if p.strip()]


def normalise(profiles: DataFrame, value: str = "reads_per_theoretical", decimals: int | None = None) -> DataFrame:
    """(taxon, sample, value): each value as a share of its sample's sum; samples that sum to 0 keep their values. ``decimals`` rounds first, as text tables do."""
    v = F.round(value, decimals) if decimals is not None else F.col(value)
    long = profiles.select("taxon", "sample", v.cast("double").alias("value"))
    total = F.sum("value").over(W.partitionBy("sample"))
    return long.withColumn("t", total).select("taxon", "sample", F.when(F.col("t") > 0, F.col("value") / F.col("t")).otherwise(F.col("value")).alias("value"))


def pivot(long: DataFrame, samples: Sequence[str], row: str = "taxon") -> DataFrame:
    """Rows with any value above 0, a column for each sample in the order given, 0 where there is no value."""
    samples = list(samples)
    wide = long.where(F.col("sample").isin(samples)).groupBy(row).pivot("sample", samples).agg(F.sum("value"))
    wide = wide.na.fill(0.0, samples)
    return wide.where(F.greatest(*[F.col(f"`{s}`") for s in samples], F.lit(0.0)) > 0) if samples else wide


def _is_one_of(samples: str | Sequence[str] | Column | None) -> Column:
    return samples if isinstance(samples, Column) else F.col("sample").isin(names(samples))


def without_contamination(long: DataFrame, controls: str | Sequence[str] | Column | None, mocks: str | Sequence[str] | Column | None = None) -> DataFrame:
    """Drops control and mock samples, given by name or by a condition on ``sample``, and every taxon that any control has."""
    is_control, is_mock = _is_one_of(controls), _is_one_of(mocks)
    tainted = long.where(is_control & (F.col("value") > 0)).select("taxon").distinct()
    return long.where(~is_control & ~is_mock).join(tainted, "taxon", "left_anti")


def unpivot(wide: DataFrame, keys: Sequence[str], name: str, value: str = "value") -> DataFrame:
    """Wide table to long; what is no number becomes 0."""
    columns = [c for c in wide.columns if c not in keys]
    text = wide.select(*keys, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = text.unpivot(list(keys), [f"`{c}`" for c in columns], name, value)
    return long.withColumn(value, F.coalesce(F.expr(f"try_cast(`{value}` AS double)"), F.lit(0.0)))


def predict(long: DataFrame, mapping: DataFrame) -> DataFrame:
    """(function, sample, value): abundance times copies, summed over the species (last rank of the taxon) and normalised for each sample; samples that sum to 0 stay as they are."""
    species = long.select(F.element_at(F.split("taxon", "\t"), -1).alias("species"), "sample", F.col("value").alias("share")).where("share != 0")
    raw = species.join(mapping.select("species", "function", "copies"), "species").groupBy("sample", "function").agg(F.sum(F.col("share") * F.col("copies")).alias("value"))
    total = F.sum("value").over(W.partitionBy("sample"))
    return raw.withColumn("t", total).select("function", "sample", F.when(F.col("t") > 0, F.col("value") / F.col("t")).otherwise(F.col("value")).alias("value"))


def matched_species(long: DataFrame, mapping: DataFrame) -> DataFrame:
    """For each sample the species with an abundance, and how many of them the mapping knows."""
    mine = long.where("value != 0").select("sample", F.element_at(F.split("taxon", "\t"), -1).alias("species")).distinct()
    known = mapping.select("species").distinct().withColumn("known", F.lit(1))
    return mine.join(known, "species", "left").groupBy("sample").agg(F.count(F.lit(1)).alias("n_species"), F.count("known").alias("n_matched"))
