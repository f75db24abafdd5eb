"""Quantifying taxa in samples by their marker tags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import present


@dataclass(frozen=True)
class Thresholds:
    """A taxon is kept if it reaches every one; relative abundance refers to all taxa detected in the sample, before any is dropped."""

    g_score: float = 0.0
    tag_depth: float = 0.0
    percent: float = 0.0
    relative_abundance: float = 0.0


def tag_depth(read_tags: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Reads of each tag in each sample; null tags and samples are left out."""
    return present(read_tags.select(*by, "tag")).groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("depth"))


def abundance(depth: DataFrame, markers: DataFrame, theory: DataFrame, thresholds: Thresholds = Thresholds(), by: Sequence[str] = ("sample",), db: Sequence[str] = ()) -> DataFrame:
    """Abundance of each taxon: theoretical and sequenced tags, reads, tags with more than one read, ratios and G score.

    ``depth`` (by, tag, depth) meets the distinct (db, tag, taxon) of the markers, so that a read counts once for a taxon
    however many of its genomes have the tag. ``db``: columns that depth and markers share beside the tag, such as enzyme or sample.
    """
    on = [*db, "tag"]
    known = markers.select(*on, "taxon").distinct()
    hits = depth.join(known, on)
    keys = list(dict.fromkeys([*by, *db]))
    got = hits.groupBy(*keys, "taxon").agg(F.count(F.lit(1)).alias("sequenced_tag_num"), F.sum("depth").cast("bigint").alias("sequenced_reads_num"), F.count_if(F.col("depth") > 1).alias("sequenced_tag_num_gt1"))
    total = F.sum("sequenced_reads_num").over(W.partitionBy(*keys))
    got = got.withColumn("total_reads", total)
    got = got.join(theory.select(*db, "taxon", "theoretical_tag_num"), [*db, "taxon"], "left").withColumn("theoretical_tag_num", F.coalesce("theoretical_tag_num", F.lit(0.0)))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tags, reads, expected = F.col("sequenced_tag_num"), F.col("sequenced_reads_num"), F.col("theoretical_tag_num")
    out = got.select(
        *keys, "taxon", "theoretical_tag_num", "sequenced_tag_num", (ratio(tags, expected) * 100).alias("percent"), "sequenced_reads_num", ratio(reads, expected).alias("reads_per_theoretical"),
        ratio(reads, tags).alias("reads_per_sequenced"), "sequenced_tag_num_gt1", F.sqrt((tags * reads).cast("double")).alias("g_score"), (ratio(reads, F.col("total_reads")) * 100).alias("relative_abundance"),
    )
    return out.where((F.col("g_score") >= thresholds.g_score) & (F.col("reads_per_sequenced") >= thresholds.tag_depth) & (F.col("percent") >= thresholds.percent) & (F.col("relative_abundance") >= thresholds.relative_abundance))


def gcf_detected(depth: DataFrame, markers: DataFrame, theory: DataFrame, by: Sequence[str] = ("sample",), db: Sequence[str] = ()) -> DataFrame:
    """Distinct marker tags of each genome found in each sample, with its theory and the detected fraction."""
    on = [*db, "tag"]
    keys = list(dict.fromkeys([*by, *db]))
    hits = depth.select(*keys, "tag").distinct().join(markers.select(*on, "taxon", "gcf_id").distinct(), on)
    got = hits.groupBy(*keys, "taxon", "gcf_id").agg(F.count(F.lit(1)).alias("detected"))
    out = got.join(theory.select(*db, "taxon", "gcf_id", "theory"), [*db, "taxon", "gcf_id"], "left").withColumn("theory", F.coalesce("theory", F.lit(0)))
    return out.select(*keys, "taxon", "gcf_id", "theory", "detected", F.coalesce(F.try_divide(F.col("detected").cast("double"), F.col("theory").cast("double")), F.lit(0.0)).alias("fraction"))


def find_genomes(profile: DataFrame, detected: DataFrame, g_score: float = 5.0, min_tags: int = 1) -> DataFrame:
    """Genomes (sample, gcf_id, taxon) for a sample's own database: of taxa above ``g_score`` in any enzyme, with more than ``min_tags`` tags in any enzyme."""
    passing = profile.where(F.round("g_score", 8) > int(g_score)).select("sample", "taxon").distinct()
    return detected.where(F.col("detected") > min_tags).join(passing, ["sample", "taxon"], "left_semi").select("sample", "gcf_id", "taxon").distinct()


def selected_lineages(selected: DataFrame, genomes: DataFrame) -> DataFrame:
    """(sample, gcf_id, taxonomy) of the selected genomes that are listed, in order of sample and genome."""
    return selected.select("sample", "gcf_id").distinct().join(genomes.select("gcf_id", "taxonomy"), "gcf_id").select("sample", "gcf_id", "taxonomy").orderBy("sample", "gcf_id")
