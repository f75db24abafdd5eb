"""Marker tags: tags that occur in the genomes of one taxon only, for any ranks at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..session import present


def latest_listing(listings: DataFrame, genome: str, order: Sequence[Column | str], value: Column | str) -> DataFrame:
    """One row (genome, value) per genome: of several listings the last by ``order``."""
    c = F.col(value) if isinstance(value, str) else value
    return listings.where(F.col(genome).isNotNull()).groupBy(genome).agg(F.max_by(c, F.struct(*order)).alias("taxonomy"))


def tag_occurrences(tags: DataFrame, genomes: DataFrame, levels: Sequence[str | int], extra: Sequence[str] = (), tag: str = "tag", clamp: bool = False) -> DataFrame:
    """(extra, level, tag, gcf_id, taxon, n): occurrences in genomes with a lineage; the taxon is the path of ranks down to the level.

    Occurrences are counted per tag and genome before the genomes' lineages are joined and the levels fanned out, so a tag
    that occurs very often costs no more than one row per genome and level. Null tags and unlisted genomes are left out.
    """
    counts = present(tags.select(*extra, F.col(tag).alias("tag"), "gcf_id"), "tag", "gcf_id").groupBy(*extra, "tag", "gcf_id").agg(F.count(F.lit(1)).alias("n"))
    paths = F.explode(F.array(*[F.struct(F.lit(tx.RANKS[tx.level_number(k) - 1]).alias("level"), tx.rank_path("taxonomy", k, clamp).alias("taxon")) for k in levels]))
    taxa = genomes.select("gcf_id", paths.alias("p")).select("gcf_id", "p.level", "p.taxon").where("taxon IS NOT NULL")
    return counts.join(taxa, "gcf_id").select(*extra, "level", "tag", "gcf_id", "taxon", "n")


def unique_markers(occurrences: DataFrame, extra: Sequence[str] = (), drop_redundant: bool = True) -> DataFrame:
    """Occurrences of tags that only one taxon has. Uniqueness is judged on all occurrences; then, with ``drop_redundant``, a tag is dropped for genomes that have it more than once.

    Whether a tag's taxa are all the same is found with partial aggregation in every task, so a tag that nearly all genomes have is one state
    per task, and only tags of a single taxon are joined back. No window holds the occurrences of a tag; a join on a crowded tag can be split. Occurrences with a null in an ``extra`` column are left out.
    """
    keys = [*extra, "level", "tag"]
    # Two 64-bit hashes stand for the taxon: smallest and largest text can't be kept in a hash aggregate and would have every task sort its rows.
    codes = [F.xxhash64("taxon"), F.xxhash64("taxon", F.lit(1))]
    bounds = [f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(codes) for f in (F.min, F.max)]
    # The number of occurrences is kept up to the filter (it is never 0), so that both sides read the same shuffled counts.
    judged = occurrences.groupBy(*keys).agg(*bounds, F.max("n").alias("most"))
    alone = judged.where("min_0 = max_0 AND min_1 = max_1 AND most > 0").select(*keys)
    # Grouped as it is joined: the tags that are alone are not moved again.
    return (occurrences.where("n = 1") if drop_redundant else occurrences).join(alone, keys, "left_semi").select(*occurrences.columns)


def gcf_theory(markers: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Marker tags (occurrences) of each genome."""
    return markers.groupBy(*extra, "level", "taxon", "gcf_id").agg(F.sum("n").cast("bigint").alias("theory"))


def taxon_theory(markers: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Mean number of marker tags of the genomes of a taxon that have any."""
    return gcf_theory(markers, extra).groupBy(*extra, "level", "taxon").agg(F.avg("theory").alias("theoretical_tag_num"), F.count(F.lit(1)).alias("n_genomes"))


def genome_coverage(markers: DataFrame, genomes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Genomes with markers at each level, and their whole percent of all listed genomes."""
    total = genomes.where("gcf_id IS NOT NULL").select(F.count_distinct("gcf_id")).scalar()
    got = markers.groupBy(*extra, "level").agg(F.count_distinct("gcf_id").alias("n_genomes"))
    return got.withColumn("percent", F.floor(F.try_divide(F.col("n_genomes") * 100, total)).cast("bigint"))


def sample_markers(tags: DataFrame, selected: DataFrame, genomes: DataFrame, level: str | int, drop_redundant: bool = True) -> DataFrame:
    """Markers of every sample's own selection of genomes (sample, gcf_id) in one pass: uniqueness within (sample, tag)."""
    mine = present(tags.select("tag", "gcf_id")).join(present(selected.select("sample", "gcf_id")).distinct(), "gcf_id")
    return unique_markers(tag_occurrences(mine, genomes, [level], ["sample"], clamp=True), ["sample"], drop_redundant)
