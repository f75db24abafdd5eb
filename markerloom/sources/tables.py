"""Text tables in and out: sample and genome lists, profiles, matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import taxonomy as tx


def data_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, parts): trimmed lines split at tabs; blank lines and those starting with ``#`` are left out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("parts", F.split("line", "\t"))


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample, r1, r2) of a batch list; lines of fewer than two columns are left out, r2 is null where missing."""
    rows = data_lines(spark, path).where(F.size("parts") >= 2)
    return rows.select(F.col("parts")[0].alias("sample"), F.col("parts")[1].alias("r1"), F.nullif(F.try_element_at("parts", F.lit(3)), F.lit("")).alias("r2"))


def sample_names(spark: SparkSession, path: str) -> DataFrame:
    return data_lines(spark, path).select(F.col("parts")[0].alias("sample"))


def genome_list(spark: SparkSession, path: str) -> DataFrame:
    """(gcf_id, taxonomy, genome_path) of a list in columns (id, eight ranks, path) or with lineages (id, ``d__..``, path), told apart by its first line."""
    rows = data_lines(spark, path)
    first = rows.select("parts").first()
    if first is None:
        return spark.createDataFrame([], "gcf_id STRING, taxonomy ARRAY<STRING>, genome_path STRING")
    head = first["parts"]
    if len(head) >= 2 and ("d__" in head[1] or head[1] == "gtdb_taxonomy"):
        if head[0] in ("accession", "GCF_ID"):
            rows = rows.where(F.col("line") != F.lit("\t".join(head)))
        gcf = tx.accession(F.col("parts")[0])
        rows = rows.where(F.size("parts") >= 2).withColumn("gcf_id", gcf)
        return rows.select("gcf_id", tx.parse_lineage(F.col("parts")[1], "gcf_id").alias("taxonomy"), F.try_element_at("parts", F.lit(3)).alias("genome_path"))
    rows = rows.where(F.size("parts") >= 9)
    return rows.select(F.col("parts")[0].alias("gcf_id"), F.slice("parts", 2, 8).alias("taxonomy"), F.try_element_at("parts", F.lit(10)).alias("genome_path"))


def rank_list(spark: SparkSession, path: str) -> DataFrame:
    """(gcf_id, taxonomy): an id and any number of ranks, each trimmed."""
    rows = data_lines(spark, path).where(F.size("parts") >= 2)
    return rows.select(F.trim(F.col("parts")[0]).alias("gcf_id"), F.transform(F.slice("parts", F.lit(2), F.size("parts") - 1), lambda x: F.trim(x)).alias("taxonomy"))


def profile_table(spark: SparkSession, path: str | list[str], keep_line: bool = False) -> DataFrame:
    """(file, taxon, eight metrics, the line itself if wanted) of profile tables without regard to the number of rank columns; numbers that can't be read are 0."""
    metrics = ("theoretical_tag_num", "sequenced_tag_num", "percent", "sequenced_reads_num", "reads_per_theoretical", "reads_per_sequenced", "sequenced_tag_num_gt1", "g_score")
    rows = data_lines(spark, path).where(F.size("parts") > 8)
    taxon = F.concat_ws("\t", F.slice("parts", F.lit(1), F.size("parts") - 8))

    def number(i: int):
        return F.coalesce(F.regexp_replace(F.element_at("parts", i - 8), "%$", "").try_cast("double"), F.lit(0.0))

    return rows.select("file", taxon.alias("taxon"), *[number(i).alias(m) for i, m in enumerate(metrics)], *["line"] * keep_line)


def combined_profile(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Enzymes named by the ``#A B combine`` lines, and (taxon, g_score) of the rows."""
    heads = spark.read.text(path).where(F.col("value").startswith("#") & F.col("value").contains("combine")).select(F.explode(F.split(F.regexp_replace("value", "^#", ""), r"\s+")).alias("e")).where("e != 'combine' AND e != ''")
    enzymes = sorted(r["e"] for r in heads.distinct().collect())  # one line of names
    rows = data_lines(spark, path).where(F.size("parts") > 8)
    return enzymes, rows.select(F.concat_ws("\t", F.slice("parts", F.lit(1), F.size("parts") - 8)).alias("taxon"), F.coalesce(F.element_at("parts", -1).try_cast("double"), F.lit(0.0)).alias("g_score"))


def detected_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, taxon, gcf_id, theory, detected) of genome detection tables; a number that can't be read is 0."""
    rows = data_lines(spark, path).where(F.size("parts") > 4)
    n = lambda i: F.coalesce(F.element_at("parts", i).try_cast("bigint"), F.lit(0))
    return rows.select("file", F.concat_ws("\t", F.slice("parts", F.lit(1), F.size("parts") - 4)).alias("taxon"), F.element_at("parts", -4).alias("gcf_id"), n(-3).alias("theory"), n(-2).alias("detected"))


def wide_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header that may start with ``#``, all columns as text."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("#"))


def mapping_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(species, function, copies) of a wide table; the last of repeated species wins; text that is no number is 0."""
    from ..operators.matrix import unpivot

    wide = wide_table(spark, path)
    if len(wide.columns) < 2:
        raise ValueError("a mapping needs a species and at least one function column")
    key = wide.columns[0]
    functions = wide.columns[1:]
    last = wide.withColumn("_at", F.monotonically_increasing_id()).groupBy(key).agg(*[F.max_by(F.col(f"`{c}`"), "_at").alias(c) for c in functions])
    return unpivot(last, [key], "function", "copies").withColumnRenamed(key, "species")


def merged_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, sample, value) of a merged table: the leading rank columns form the taxon; the last of repeated species wins."""
    from ..operators.matrix import unpivot

    wide = wide_table(spark, path)
    ranks = []
    for c in wide.columns:
        if c.strip().lower() not in tx.RANKS:
            break
        ranks.append(c)
    if not ranks:
        raise ValueError("no rank column at the start of the table")
    samples = [c for c in wide.columns if c not in ranks]
    keyed = wide.withColumn("taxon", F.concat_ws("\t", *ranks)).withColumn("_at", F.monotonically_increasing_id())
    last = keyed.groupBy(F.col(ranks[-1]).alias("_species")).agg(F.max_by("taxon", "_at").alias("taxon"), *[F.max_by(F.col(f"`{c}`"), "_at").alias(c) for c in samples])
    return unpivot(last.drop("_species"), ["taxon"], "sample")


@F.pandas_udf(T.StringType())
def shortest_decimal(x: pd.Series) -> pd.Series:
    """Shortest text that reads back as the same number, without exponent or trailing ``.0``."""
    return x.map(lambda v: None if pd.isna(v) else np.format_float_positional(v, trim="-"))


def write_table(df: DataFrame, path: str, header: bool = True, partition_by: list[str] | None = None) -> None:
    """Tab-separated text, quoted nowhere."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def profile_rows(profile: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Metric columns as they stand in text, after the columns ``keep`` (sample, taxon): ratios with 8 decimals, the percentage with its sign."""
    f = lambda c: F.format_string("%.8f", F.col(c))
    return profile.select(*(keep or ["sample", "taxon"]), f("theoretical_tag_num").alias("Theoretical_Tag_Num"), F.col("sequenced_tag_num").alias("Sequenced_Tag_Num"), F.format_string("%.8f%%", "percent").alias("Percent"), F.col("sequenced_reads_num").alias("Sequenced_Reads_Num"), f("reads_per_theoretical").alias("Sequenced_Reads_Num/Theoretical_Tag_Num"), f("reads_per_sequenced").alias("Sequenced_Reads_Num/Sequenced_Tag_Num"), F.col("sequenced_tag_num_gt1").alias("Sequenced_Tag_Num(depth>1)"), f("g_score").alias("G_Score"))


def write_classification(genomes: DataFrame, path: str) -> None:
    """``gcf TAB ranks`` lines, gzip."""
    genomes.select(F.concat_ws("\t", "gcf_id", F.concat_ws("\t", "taxonomy")).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def classification_lines(genomes: DataFrame) -> DataFrame:
    """Distinct ``gcf TAB ranks`` lines in order."""
    return genomes.select(F.concat_ws("\t", "gcf_id", F.concat_ws("\t", "taxonomy")).alias("line")).distinct().orderBy("line")
