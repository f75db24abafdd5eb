"""Folders of tag files: digests made before, and what is in them."""

from __future__ import annotations

from functools import reduce
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..enzymes import enzyme
from ..operators import inspect
from . import files, tagdb, tagstream


def digest_files(spark: SparkSession, genomes: DataFrame, folder: str, key: str | int, for_samples: bool = False) -> DataFrame:
    """(gcf_id, path) of each genome's digest in ``folder``: the first name that exists, in an order that differs ``for_samples``; path is null without one."""
    name = enzyme(key).name
    short = F.concat_ws(".", F.slice(F.split("gcf_id", r"\."), 1, 2))
    if for_samples:
        wanted = [(short, "iibdb"), (F.col("gcf_id"), "iibsp"), (F.col("gcf_id"), "iibdb")]
    else:
        wanted = [(short, "iibdb"), (F.col("gcf_id"), "iibdb"), (short, "iibsp")]
    names = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(stem, F.lit(f".{name}.{end}")).alias("name")) for i, (stem, end) in enumerate(wanted)])
    there = spark.createDataFrame([(p.rsplit("/", 1)[-1], p) for p in files.expand(folder, tagstream.SUFFIXES)], "name STRING, path STRING")
    tried = genomes.select("gcf_id").dropna().distinct().select("gcf_id", F.explode(names).alias("t")).select("gcf_id", "t.rank", "t.name")
    return tried.join(there, "name", "left").groupBy("gcf_id").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("rank"))).alias("path"))


def made_digests(spark: SparkSession, genomes: DataFrame, folder: str, key: str | int, for_samples: bool = False) -> DataFrame:
    """Tags (gcf_id, contig, pos, hash) of digests made before; genomes without a file or with a broken one are left out (see :func:`digest_files` for the former).

    ``for_samples`` keeps ids that carry their genome already (``GCF_..|..|contig|pos|..``) as they are.
    """
    chosen = digest_files(spark, genomes, folder, key, for_samples).where("path IS NOT NULL")
    paths = [r["path"] for r in chosen.select("path").toLocalIterator()]  # as many as files listed before
    if not paths:
        return spark.createDataFrame([], "gcf_id STRING, contig STRING, pos BIGINT, hash BIGINT")
    records = spark.read.format("tagstream").option("path", ",".join(paths)).option("broken", "skip").load()
    tagged = records.join(F.broadcast(chosen.withColumnRenamed("path", "file")), "file")
    contig, pos = inspect.split_place("id")
    if for_samples:
        carried = F.col("id").startswith("GCF_") | F.col("id").startswith("GCA_")
        parts = F.split("id", r"\|")
        part = lambda i: F.try_element_at(parts, F.lit(i))
        gcf = F.when(carried, part(1)).otherwise(F.col("gcf_id"))
        return tagged.select(gcf.alias("gcf_id"), F.when(carried, part(3)).otherwise(contig).alias("contig"), F.when(carried, part(4)).otherwise(pos).try_cast("bigint").alias("pos"), "hash")
    return tagged.select("gcf_id", contig.alias("contig"), pos.try_cast("bigint").alias("pos"), "hash")


def describe_files(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """One row per file (file, enzyme, level, kind, bytes, genomes, records, note) without reading its records, and one per file that can't be read (file, error).

    ``records`` stands in the head of compact databases of version 3 and is null elsewhere; see :func:`count_records` for the rest.
    """
    good, bad = [], []
    for path in files.expand(paths, tagstream.SUFFIXES):
        try:
            system, inner = files.locate(path)
            size = system.get_file_info(inner).size
            if tagdb.is_compact(path):
                with files.open_input(path) as f:
                    version, count, genomes = tagdb.read_header(f)
                good.append((path, "compact", size, len(genomes), count, f"version {version}", None))
            else:
                with files.open_input(path) as f:
                    first = next(tagstream.parse(f), (None, None))[1]
                good.append((path, "stream", size, None, None, None, first))
        except (ValueError, OSError) as e:
            bad.append((path, str(e)))
    rows = spark.createDataFrame(good, "file STRING, form STRING, size BIGINT, genomes BIGINT, records BIGINT, note STRING, first_id STRING")
    hint_enzyme, hint_level = inspect.name_hints("file")
    kind = F.when(F.col("form") == "compact", F.lit("database")).otherwise(inspect.stream_kind("file", F.coalesce("first_id", F.lit(""))))
    return rows.select("file", hint_enzyme.alias("enzyme"), hint_level.alias("level"), kind.alias("kind"), inspect.human_bytes("size").alias("bytes"), "genomes", "records", "note"), spark.createDataFrame(bad, "file STRING, error STRING")


def count_records(spark: SparkSession, paths: str, distinct: bool = False) -> DataFrame:
    """Records of every file, read in full: (file, n_records, n_tags if ``distinct``)."""
    listed = files.expand(paths, tagstream.SUFFIXES)
    compact = [p for p in listed if tagdb.is_compact(p)]
    streams = [p for p in listed if p not in set(compact)]
    parts = [spark.read.format(f).option("path", ",".join(ps)).load().select("file", "hash") for f, ps in (("tagdb", compact), ("tagstream", streams)) if ps]
    if not parts:
        raise FileNotFoundError(paths)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    more = [F.count_distinct("hash").alias("n_tags")] if distinct else []
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), *more)


def first_records(path: str, n: int) -> list[tuple]:
    """The first ``n`` records of a file as (hash unsigned, id or genome); no more of it is read than they need."""
    with files.open_input(path) as f:
        if not tagdb.is_compact(path):
            return [(h & (1 << 64) - 1, name) for h, name in islice(tagstream.parse(f), n)]
        version, _, genomes = tagdb.read_header(f)
        rows = chain.from_iterable(zip(b["hash"].tolist(), b["index"].tolist(), strict=True) for b in tagdb.records(f, version))
        return [(h & (1 << 64) - 1, genomes[i] if i < len(genomes) else None) for h, i in islice(rows, n)]


def groups_of_files(spark: SparkSession, paths: list[str], k: int, full: bool) -> DataFrame:
    """(file, place, genome, n_records): of each file the ``k`` genomes or contigs with most records, equal ones by their place in the head and name; without ``full`` the first ``k`` of the head of compact files, uncounted."""
    compact = [p for p in paths if tagdb.is_compact(p)]
    heads = []
    for path in compact:
        with files.open_input(path) as f:
            heads += [(path, i, g) for i, g in enumerate(tagdb.read_header(f)[2][: None if full else k], 1)]
    head = spark.createDataFrame(heads, "file STRING, place INT, genome STRING")
    if not full:
        return head.withColumn("n_records", F.lit(None).cast("bigint"))
    parts = [spark.read.format("tagdb").option("path", ",".join(compact)).load().select("file", F.col("gcf_id").alias("genome"))] if compact else []
    if streams := [p for p in paths if p not in set(compact)]:
        parts.append(spark.read.format("tagstream").option("path", ",".join(streams)).load().select("file", inspect.group_key("id").alias("genome")))
    counts = reduce(DataFrame.unionByName, parts).where("genome IS NOT NULL").groupBy("file", "genome").agg(F.count(F.lit(1)).alias("n_records"))
    order = W.partitionBy("file").orderBy(F.desc("n_records"), F.asc_nulls_last("place"), "genome")
    ranked = counts.join(head, ["file", "genome"], "left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.select("file", "place", "genome", "n_records")
