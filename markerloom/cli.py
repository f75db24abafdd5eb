"""``python -m markerloom COMMAND``: the operators on files, one command for each step."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from contextlib import nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .enzymes import enzyme
from .functions import dna
from .functions import taxonomy as tx
from .operators import digest, features, markers, matrix, profile
from .plans import pipeline
from .session import materialize
from .sources import collections, fastx, files, sample_files, tables

CLASSIFICATION = "abfh_classify_with_speciename.txt.gz"  # fixed value: file name of the lineages beside a database
_YES = {"yes": True, "no": False}
log = logging.getLogger("markerloom")


def _quality(a) -> dna.ReadQuality:
    return dna.ReadQuality(_YES[a.qc], a.max_n, a.min_quality, a.min_percent, a.quality_base)


def _there(samples: list[tuple], what: str = "sample") -> list[tuple]:
    """The entries (name, file, further files) whose files all exist; of the others each is named in a warning, and the run goes on without it."""
    kept = []
    for name, *paths in samples:
        gone = [p for p in paths if p and not files.exists(p)]
        if gone or not any(paths):
            log.warning("%s %s is left out: %s", what, name, f"no file {', '.join(gone)}" if gone else "no file is given")
        else:
            kept.append((name, *paths))
    if not kept:
        raise ValueError("no input: none of the files exists")
    return kept


def _reads(spark: SparkSession, samples: list[tuple[str, str, str | None]], what: str = "sample") -> DataFrame:
    """(sample, mate, ordinal, header, seq, qual) of both files of each sample."""
    listed = [(p, s, i) for s, *paths in _there(samples, what) for i, p in enumerate(paths) if p]
    names = spark.createDataFrame(listed, "file STRING, sample STRING, mate INT")
    rows = spark.read.format("fastx").option("path", ",".join(p for p, *_ in listed)).load()
    return rows.join(F.broadcast(names), "file").drop("file")


def _write_stats(stats: DataFrame, folder: str) -> None:
    columns = stats.columns
    path = F.concat(F.lit(f"{folder}/"), F.col(columns[0]), F.lit("."), F.col("enzyme"), F.lit(".stat.tsv"))
    rows = stats.withColumn("line", F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]))
    sample_files.write_tables(rows, path, [], "\t".join(["sample", *columns[1:]])).count()


def extract(spark: SparkSession, a) -> None:
    """Types: 1 genomes, 2 shotgun reads, 3 single-tag reads."""
    e = enzyme(a.site)
    if bool(a.list) == bool(a.input):
        raise ValueError("give either a list or inputs")
    samples = [tuple(r) for r in tables.sample_list(spark, a.list).collect()] if a.list else [(a.op or os.path.basename(a.input[0]).split(".")[0], *a.input[:2])]
    reads = _reads(spark, samples)
    quality = _quality(a)
    if a.type == 1:
        cut = materialize(digest.genome_digest(reads, e, "sample"), "digest").withColumn("hash", dna.tag_hash("tag"))
        sample_files.write_streams(cut.withColumn("id", F.col("contig")), "gcf_id", a.od, f".{e.name}.iibdb", ["contig", "pos"]).count()
        if a.record_pos:
            sample_files.write_streams(cut.withColumn("id", F.concat_ws("|", "contig", F.col("pos").cast("string"))), "gcf_id", a.od, f".{e.name}.pos.iibdb", ["contig", "pos"]).count()
        _write_stats(digest.digest_stats(reads, "sample", e), a.od)
    elif a.type == 2:
        good = reads.where(quality.few_n("seq") & quality.good_quality("qual"))
        tags = digest.read_tags(good, ["sample", "mate", "ordinal"], "header", e).withColumn("hash", dna.tag_hash("tag")).withColumn("id", F.col("tag_id"))
        sample_files.write_streams(tags, "sample", a.od, f".{e.name}.iibsp", ["mate", "ordinal"]).count()
        _write_stats(digest.digest_stats(reads, "sample", e, qual="qual", quality=quality), a.od)
    else:
        first = reads.where("mate = 0")
        tags = digest.first_tags(first, ["sample", "ordinal", "header"], e, qual="qual", quality=quality).where("passed").withColumn("hash", dna.tag_hash("tag")).withColumn("id", F.col("header"))
        sample_files.write_streams(tags, "sample", a.od, f".{e.name}.iibsp", ["ordinal"]).count()
        _write_stats(digest.single_tag_stats(first, "sample", e, qual="qual", quality=quality), a.od)


def _genomes(spark: SparkSession, path: str, ranks_only: bool) -> DataFrame:
    """(gcf_id, taxonomy, genome_path); of several lines of a genome the last."""
    rows = tables.rank_list(spark, path).withColumn("genome_path", F.lit(None).cast("string")) if ranks_only else tables.genome_list(spark, path)
    return rows.withColumn("at", F.monotonically_increasing_id()).groupBy("gcf_id").agg(F.max_by(F.struct("taxonomy", "genome_path"), "at").alias("g")).select("gcf_id", "g.*")


def build_database(spark: SparkSession, a, for_samples: bool) -> None:
    e = enzyme(a.site)
    levels = tx.RANKS if a.level.lower() == "all" else [tx.RANKS[tx.level_number(x) - 1] for x in a.level.split(",")]
    genomes = materialize(_genomes(spark, a.list, for_samples), "genomes")
    if a.enzyme_file:
        records = spark.read.format("tagstream").option("path", a.enzyme_file).load()
        tags = records.select(F.substring_index("id", "|", 1).alias("gcf_id"), F.col("hash").alias("tag"))
    elif a.pre_digested_dir:
        tags = collections.made_digests(spark, genomes, a.pre_digested_dir, e, for_samples).select("gcf_id", F.col("hash").alias("tag"))
    elif for_samples:
        raise ValueError("give an enzyme file or a folder of digests made before")
    else:
        paths = [(r["gcf_id"], r["genome_path"], None) for r in genomes.where("genome_path IS NOT NULL").toLocalIterator()]
        cut = digest.digest(_reads(spark, paths, "genome"), ["sample"], [e])
        tags = cut.select(F.col("sample").alias("gcf_id"), dna.tag_hash("tag").alias("tag"))
    tags = materialize(tags, "tags")
    if tags.isEmpty():
        raise ValueError("no genome gives a tag: are the sequences there?")
    found = materialize(markers.unique_markers(markers.tag_occurrences(tags, genomes, levels, clamp=for_samples), drop_redundant=_YES[a.remove_redundant]), "markers")
    _write_classification(genomes, a.output)
    for level in levels:  # a file for each rank asked for
        _write_database(found.where(F.col("level") == level), f"{a.output}/{e.name}.{level}.iibdb")


def _write_classification(genomes: DataFrame, folder: str) -> None:
    lines = genomes.select(F.concat_ws("\t", "gcf_id", F.concat_ws("\t", "taxonomy")).alias("line")).orderBy("line")
    with files.open_output(f"{folder}/{CLASSIFICATION}", "gzip") as out:
        for row in lines.toLocalIterator():
            out.write(row[0].encode() + b"\n")


def _write_database(found: DataFrame, path: str) -> None:
    """Markers (tag as hash, gcf_id, n) as a compact database."""
    rows = found.select(F.col("tag").alias("hash"), "gcf_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k")).drop("k")
    rows.coalesce(1).write.format("tagdb").option("path", path).mode("append").save()


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.data_lines(spark, f"{folder}/{CLASSIFICATION}")
    return parts.withColumn("at", F.monotonically_increasing_id()).groupBy(F.col("parts")[0].alias("gcf_id")).agg(F.max_by("line", "at").alias("line"), F.max_by(F.expr("slice(parts, 2, size(parts) - 1)"), "at").alias("taxonomy"))


def _header(level: str | int) -> str:
    return "\t".join(r.capitalize() for r in tx.RANKS[: tx.level_number(level)])


METRICS = "Theoretical_Tag_Num\tSequenced_Tag_Num\tPercent\tSequenced_Reads_Num\tSequenced_Reads_Num/Theoretical_Tag_Num\tSequenced_Reads_Num/Sequenced_Tag_Num\tSequenced_Tag_Num(depth>1)\tG_Score"


def _markers(spark: SparkSession, folder: str, enzyme_name: str, level: str, taxonomy: DataFrame) -> DataFrame:
    """(level, tag, gcf_id, taxon, n) of a compact database and the lineages beside it."""
    db = spark.read.format("tagdb").option("path", f"{folder}/{enzyme_name}.{level}.iibdb").load()
    taxa = taxonomy.select("gcf_id", tx.rank_path("taxonomy", level).alias("taxon")).where("taxon IS NOT NULL")
    counts = db.select(F.col("hash").alias("tag"), "gcf_id").dropna().groupBy("tag", "gcf_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(taxa, "gcf_id").select(F.lit(level).alias("level"), "tag", "gcf_id", "taxon", "n")


def _write_profiles(result: DataFrame, path: Column, level: str) -> None:
    """Profile tables of all samples in one job; a sample without a taxon gets none."""
    text = tables.profile_rows(result.withColumn("path", path), ["path", "taxon"])
    lines = text.select("path", "taxon", F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in text.columns if c != "path"]).alias("line"))
    sample_files.write_tables(lines, F.col("path"), ["taxon"], f"#{_header(level)}\t{METRICS}").count()


def quantify(spark: SparkSession, a) -> None:
    e = enzyme(a.site)
    listed = _there([(r["sample"], r["r1"]) for r in tables.sample_list(spark, a.list).collect()])
    found = materialize(_markers(spark, a.database, e.name, a.level, _classified(spark, a.database)), "markers")
    depth = materialize(profile.tag_depth(sample_files.load_streams(spark, listed).withColumnRenamed("hash", "tag")), "depth")
    limits = profile.Thresholds(a.gscore, a.min_tag_depth, a.min_percent, a.min_relative_abundance)
    result = materialize(profile.abundance(depth, found, markers.taxon_theory(found), limits), "profile")
    detected = materialize(profile.gcf_detected(depth, found, markers.gcf_theory(found)), "detected")
    detail = depth.join(found.select("tag", "taxon").distinct(), "tag").join(result.select("sample", "taxon"), ["sample", "taxon"], "left_semi")
    base = F.concat(F.lit(f"{a.output}/"), F.col("sample"), F.lit("/"), F.col("sample"), F.lit(f".{e.name}"))
    _write_profiles(result, F.concat(base, F.lit(".xls")), a.level)
    found_rows = detected.withColumn("line", F.concat_ws("\t", "taxon", "gcf_id", F.col("theory").cast("string"), F.col("detected").cast("string"), F.format_string("%.4f", "fraction")))
    sample_files.write_tables(found_rows, F.concat(base, F.lit(".GCF_detected.xls")), ["taxon", "gcf_id"]).count()
    if _YES[a.verbose]:
        named = detail.select("sample", F.element_at(F.split("taxon", "\t"), -1).alias("leaf"), F.concat_ws("\t", dna.unsigned("tag").cast("string"), F.col("depth").cast("string")).alias("line"))
        named.write.mode("overwrite").partitionBy("sample", "leaf").text(f"{a.output}/{e.name}.detail")


def find_genome(spark: SparkSession, a) -> None:
    samples = [r[0] for r in tables.sample_names(spark, a.list).collect()]
    lines = _classified(spark, a.database).select("gcf_id", "line")
    passing, detected = None, None
    for s in samples:  # file names only; the tables are read together
        folder = f"{a.qual_dir}/{s}"
        names = [p for p in files.expand(folder, (".xls",)) if os.path.basename(p).startswith(f"{s}.") and os.path.dirname(p) == folder.rstrip("/")]
        combined = [p for p in names if p.endswith(f"{s}.combine.xls")]
        tags = [p for p in names if p.endswith(".GCF_detected.xls")]
        if combined:
            enzymes, rows = tables.combined_profile(spark, combined[0])
            tags = [p for p in tags if os.path.basename(p).split(".")[-3] in enzymes]
        else:
            single = [p for p in names if p not in tags]
            if not single:
                continue
            rows = tables.profile_table(spark, single)
        tags = [p for p in tags if files.exists(f"{a.database}/{os.path.basename(p).split('.')[-3]}.{a.level}.iibdb")]
        if not tags:
            continue
        rows = rows.select(F.lit(s).alias("sample"), "taxon", "g_score")
        mine = tables.detected_table(spark, tags).select(F.lit(s).alias("sample"), "taxon", "gcf_id", "detected")
        passing, detected = (rows, mine) if passing is None else (passing.unionByName(rows), detected.unionByName(mine))
    if detected is None:
        raise ValueError("no sample has results to select from")
    chosen = materialize(profile.find_genomes(passing, detected, a.gscore, a.gcf).join(lines, "gcf_id"), "selected")
    sample_files.write_tables(chosen.select("sample", "line").distinct(), F.concat(F.lit(f"{a.output}/"), F.col("sample"), F.lit("/sdb.list")), ["line"]).count()


def _matrix_file(wide: DataFrame, samples: list[str], path: str, header: str) -> None:
    text = wide.orderBy("taxon").select(F.concat_ws("\t", "taxon", *[tables.shortest_decimal(F.col(f"`{s}`")) for s in samples]))
    sample_files.write_lines(text, path, "\t".join([header, *samples]))


def merge(spark: SparkSession, a) -> None:
    listed = [(r["sample"], r["r1"]) for r in tables.sample_list(spark, a.list).collect()]
    if not listed:
        raise ValueError("no sample to merge")
    names = spark.createDataFrame([(os.path.basename(p), s) for s, p in listed], "base STRING, sample STRING")
    rows = tables.profile_table(spark, [p for _, p in listed]).withColumn("base", F.substring_index("file", "/", -1)).join(F.broadcast(names), "base")
    long = materialize(matrix.normalise(rows.groupBy("sample", "taxon").agg(F.sum("reads_per_theoretical").alias("reads_per_theoretical"))), "merged")
    ranks = long.select(F.max(F.size(F.split("taxon", "\t")))).first()[0] or 7
    samples = [s for s, _ in listed]
    out = set(matrix.names(a.mock)) | set(matrix.names(a.control))
    kept = [s for s in samples if s not in out]
    _matrix_file(matrix.pivot(long, samples), samples, f"{a.output}/{a.prefix}.all.xls", f"#{_header(ranks)}")
    _matrix_file(matrix.pivot(matrix.without_contamination(long, a.control, a.mock), kept), kept, f"{a.output}/{a.prefix}.filtered.xls", f"#{_header(ranks)}")


def predict(spark: SparkSession, a) -> None:
    long = tables.merged_matrix(spark, a.abundance)
    wide = tables.wide_table(spark, a.abundance)
    samples = [c for c in wide.columns if c.strip().lower() not in tx.RANKS]
    mapping = tables.mapping_matrix(spark, a.mapping)
    functions = tables.wide_table(spark, a.mapping).columns[1:]
    result = matrix.predict(long, mapping)
    rows = result.groupBy("function").pivot("sample", samples).agg(F.sum("value")).na.fill(0.0, samples)
    place = F.array_position(F.array(*map(F.lit, functions)), F.col("function"))
    rows = rows.where(F.exists(F.array(*[F.col(f"`{s}`") for s in samples]), lambda v: v != 0)).orderBy(place)
    text = rows.select(F.concat_ws("\t", "function", *[F.format_string("%.8f", F.col(f"`{s}`")) for s in samples]))
    sample_files.write_lines(text, f"{a.output}/{a.prefix}.func.xls", "\t".join(["#Function", *samples]))


def classify(spark: SparkSession, a) -> None:
    """Adds the model's label to each row of a profile table, which otherwise stays as it stands."""
    head = spark.read.text(a.input).where(F.col("value").startswith("#")).first()
    with files.open_input(a.model) as f:
        model = b"".join(iter(lambda: f.read(1 << 20), b""))
    rows = tables.profile_table(spark, a.input, keep_line=True).withColumn("sample", F.lit("")).withColumn("at", F.monotonically_increasing_id())
    scored = features.predict_presence(features.classifier_features(rows), model)
    lines = scored.orderBy("at").select(F.concat_ws("\t", "line", F.col("prediction").cast("string")))
    sample_files.write_lines(lines, a.output, f"{head[0] if head else f'#{_header(a.level)}\t{METRICS}'}\tPrediction")


def convert_lineages(spark: SparkSession, a) -> None:
    """Accessions and ``d__..;p__..`` lineages of at least seven ranks to the lineages file of a database; rows that are none are named in warnings."""
    rows = tables.data_lines(spark, a.input).where((F.size("parts") >= 2) & ~F.col("line").startswith("accession"))
    gcf = tx.accession(F.col("parts")[0])
    parsed = materialize(rows.select("line", gcf.alias("gcf_id"), tx.parse_lineage(F.col("parts")[1], gcf, strict=True).alias("taxonomy")), "lineages")
    for row in parsed.where("taxonomy IS NULL").select("line").toLocalIterator():
        log.warning("left out, fewer than seven ranks: %s", row["line"])
    _write_classification(parsed.where("taxonomy IS NOT NULL"), a.output)


def inspect_files(spark: SparkSession, a) -> None:
    """A report of a row for every file and every error, of the first records of each file and of its genomes: the largest with ``--full``, else the first of the file's head."""
    rows, broken = collections.describe_files(spark, ",".join(a.files))
    rows = materialize(rows, "described")
    paths = [r["file"] for r in rows.select("file").orderBy("file").toLocalIterator()]
    if (a.full or a.distinct) and paths:
        rows = rows.join(collections.count_records(spark, ",".join(paths), a.distinct), "file", "left")
    with files.open_output(a.out_file) if a.out_file else nullcontext(sys.stdout.buffer) as out:

        def say(*cells) -> None:
            out.write(("\t".join("" if c is None else str(c) for c in cells) + "\n").encode())

        say(*rows.columns)
        for r in rows.orderBy("file").toLocalIterator():
            say(*r)
        for r in broken.orderBy("file").toLocalIterator():
            say("error", *r)
        for path in paths if a.records else ():
            for i, record in enumerate(collections.first_records(path, a.records), 1):
                say("record", path, i, *record)
        if a.top and paths:
            for r in collections.groups_of_files(spark, paths, a.top, a.full).orderBy("file", "place").toLocalIterator():
                say("genome", *r)
        out.flush()


def _ready_database(spark: SparkSession, a, names: tuple[str, ...], level: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genomes, digest (tags as hashes) and markers of a database made before; its digest lies beside it or is named by ``-e``."""
    genomes = materialize(_classified(spark, a.database).select("gcf_id", "taxonomy"), "genomes")
    tags = [_digest_file(spark, a.enzyme_file or f"{a.database}/{n}.enzyme.iibdb", n) for n in names]
    ready = [_markers(spark, a.database, n, level, genomes).withColumn("enzyme", F.lit(n)) for n in names]
    return genomes, reduce(DataFrame.unionByName, tags), reduce(DataFrame.unionByName, ready)


def _digest_file(spark: SparkSession, path: str, enzyme_name: str) -> DataFrame:
    records = spark.read.format("tagstream").option("path", path).load()
    return records.select(F.substring_index("id", "|", 1).alias("gcf_id"), F.lit(enzyme_name).alias("enzyme"), F.col("hash").alias("tag"))


def _write_stages(out: dict[str, DataFrame], genomes: DataFrame, names: tuple[str, ...], level: str, folder: str, hashed: bool) -> None:
    """A database as the other commands, and ``--database``, take it: markers, lineages, and the digest, a folder of record streams for each enzyme."""
    as_hash = lambda df: df if hashed else df.withColumn("tag", dna.tag_hash("tag"))
    _write_classification(genomes, folder)
    for n in names:
        _write_database(as_hash(out["markers"].where(F.col("enzyme") == n)), f"{folder}/{n}.{level}.iibdb")
        records = as_hash(out["digest"].where(F.col("enzyme") == n)).select(F.col("tag").alias("hash"), F.concat("gcf_id", F.lit("|0||0|0|-")).alias("id"))
        records.write.format("tagstream").option("path", f"{folder}/{n}.enzyme.iibdb").mode("append").save()


def run_pipeline(spark: SparkSession, a) -> None:
    if a.use_pear == "yes":
        raise ValueError("paired reads are not merged here: merge them first and list the result")
    settings = pipeline.Settings(
        enzymes=tuple(enzyme(x).name for x in a.site.split(",")), level=tx.RANKS[tx.level_number(a.level) - 1], quality=_quality(a), g_score=a.gscore, min_tags=a.gcf,
        thresholds=profile.Thresholds(a.min_gscore, a.min_tag_depth, a.min_percent_taxon, a.min_relative_abundance), mocks=a.mock or "", controls=a.control or "", as_text=True,
    )
    if a.mode != "db-only" and not a.samples:
        raise ValueError(f"mode {a.mode} needs a list of samples")
    contigs = tags = ready = None
    inputs: list = [a.database, a.enzyme_file, a.pre_digested_dir]
    if a.database:
        genomes, tags, ready = _ready_database(spark, a, settings.enzymes, settings.level)
    elif not (a.taxonomy or a.genome_list):
        raise ValueError("give lineages or a genome list, or a database")
    else:
        genomes = materialize(_genomes(spark, a.taxonomy or a.genome_list, False), "genomes")
        if a.enzyme_file:
            if len(settings.enzymes) > 1:
                raise ValueError("one digest file serves one enzyme")
            tags = _digest_file(spark, a.enzyme_file, settings.enzymes[0])
        elif a.pre_digested_dir:
            made = [collections.made_digests(spark, genomes, a.pre_digested_dir, n).select("gcf_id", F.lit(n).alias("enzyme"), F.col("hash").alias("tag")) for n in settings.enzymes]
            tags = reduce(DataFrame.unionByName, made)
        else:
            paths = {r["gcf_id"]: r["genome_path"] for r in genomes.where("genome_path IS NOT NULL").toLocalIterator()}
            if a.genome_list and a.taxonomy:  # sequences may be listed apart from lineages
                paths |= {r["sample"]: r["r1"] for r in tables.sample_list(spark, a.genome_list).toLocalIterator()}
            inputs.append(sorted(paths.items()))
            if a.mode != "sample-only":
                contigs = _reads(spark, [(g, p, None) for g, p in paths.items()], "genome").select(F.col("sample").alias("gcf_id"), "seq")
    samples = _there([tuple(r) for r in tables.sample_list(spark, a.samples).collect()]) if a.samples and a.mode != "db-only" else []
    reads = _reads(spark, samples) if samples else None
    mapping = tables.mapping_matrix(spark, a.ko_mapping) if a.ko_mapping else None
    out = pipeline.run(contigs, genomes, reads, settings, f"{a.outdir}/stages", mapping, inputs, a.mode, samples, _YES[a.resume], tags, ready)
    if a.mode != "sample-only" and not a.database:
        _write_stages(out, genomes, settings.enzymes, settings.level, f"{a.outdir}/02_db_qual", tags is not None)
    if a.mode == "db-only":
        return
    for stage, folder in (("qualitative", "qualitative"), ("quantitative", "04_quantify")):
        deep = 2 if stage == "quantitative" else 1  # folders named after the sample
        path = F.concat_ws("/", F.lit(a.outdir), F.lit(folder), *[F.col("sample")] * deep, F.concat_ws(".", "sample", "enzyme", F.lit("xls")))
        _write_profiles(out[stage], path, settings.level)
    names = [s for s, *_ in samples]
    dropped = set(matrix.names(a.mock)) | set(matrix.names(a.control))
    for key, columns in (("merged", names), ("filtered", [n for n in names if n not in dropped])):
        _matrix_file(matrix.pivot(out[key], columns), columns, f"{a.outdir}/05_merge/{a.prefix}.{'all' if key == 'merged' else key}.xls", f"#{_header(settings.level)}")
    if mapping is not None:
        wide = matrix.pivot(out["functions"], names, "function").orderBy("function")
        sample_files.write_lines(wide.select(F.concat_ws("\t", "function", *[F.format_string("%.8f", F.col(f"`{s}`")) for s in names])), f"{a.outdir}/05_merge/{a.prefix}.func.xls", "\t".join(["#Function", *names]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="markerloom")
    sub = p.add_subparsers(dest="command", required=True)

    def reads(c):
        c.add_argument("--qc", choices=_YES, default="yes")
        c.add_argument("-n", "--max-n", type=float, default=0.08)
        c.add_argument("-q", "--min-quality", "--min-qual", type=int, default=30)
        c.add_argument("-p", "--min-percent-qual", "--min-quality-percent", "--min-qual-percent", dest="min_percent", type=int, default=80)
        c.add_argument("-b", "--quality-base", "--qual-base", type=int, default=33)
        c.add_argument("--use-pear", choices=_YES, default="no")  # the next two are taken and play no part: pairs are not merged here
        c.add_argument("--pe", "--pear-bin", dest="pear_bin")
        c.add_argument("--pc", type=int)

    def limits(c):
        c.add_argument("--min-tag-depth", "--min-coverage", type=float, default=0.0)
        c.add_argument("--min-relative-abundance", type=float, default=0.0)

    c = sub.add_parser("extract")
    c.add_argument("-l", "--list")
    c.add_argument("-i", "--input", nargs="+")
    c.add_argument("-t", "--type", type=int, choices=(1, 2, 3), required=True)
    c.add_argument("-s", "--site", required=True)
    c.add_argument("--od", required=True)
    c.add_argument("--op")
    c.add_argument("--record-pos", action="store_true")
    reads(c)
    for name, redundant in (("build-qual-db", "yes"), ("build-quan-db", "no")):
        c = sub.add_parser(name)
        c.add_argument("-l", "--list", required=True)
        c.add_argument("-s", "--site", required=True)
        c.add_argument("-t", "--level", "--taxonomy", default="species")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("-e", "--enzyme-file")
        c.add_argument("--pre-digested-dir")
        c.add_argument("-r", "--remove-redundant", choices=_YES, default=redundant)
    c = sub.add_parser("quantify")
    for short, name in (("-l", "list"), ("-d", "database"), ("-s", "site"), ("-o", "output")):
        c.add_argument(short, f"--{name}", required=True)
    c.add_argument("-t", "--level", "--taxonomy", default="species")
    c.add_argument("-g", "--gscore", type=float, default=0.0)
    c.add_argument("--min-percent", type=float, default=0.0)
    c.add_argument("-v", "--verbose", choices=_YES, default="yes")
    limits(c)
    c = sub.add_parser("find-genome")
    for short, name in (("-l", "list"), ("-d", "database"), ("-q", "qual-dir"), ("-o", "output")):
        c.add_argument(short, f"--{name}", required=True)
    c.add_argument("--level", default="species")
    c.add_argument("--gscore", type=int, default=5)
    c.add_argument("--gcf", type=int, default=1)
    c = sub.add_parser("merge")
    c.add_argument("-l", "--list", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-p", "--prefix", default="Abundance_Stat")
    c.add_argument("-m", "--mock")
    c.add_argument("-c", "--control")
    c = sub.add_parser("predict")
    for short, name in (("-a", "abundance"), ("-m", "mapping"), ("-o", "output")):
        c.add_argument(short, f"--{name}", required=True)
    c.add_argument("-p", "--prefix", default="Abundance_Stat")
    c = sub.add_parser("inspect")
    c.add_argument("files", nargs="+")
    c.add_argument("-f", "--full", action="store_true")
    c.add_argument("--distinct", action="store_true")
    c.add_argument("-n", "--records", type=int, default=5)
    c.add_argument("-t", "--top", type=int, default=10)
    c.add_argument("-o", "--output", dest="out_file")
    c = sub.add_parser("classify")
    for short, name in (("-i", "input"), ("-m", "model"), ("-o", "output")):
        c.add_argument(short, f"--{name}", required=True)
    c.add_argument("--level", default="species")
    c = sub.add_parser("convert-lineages")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", "--output-dir", required=True)
    c = sub.add_parser("pipeline")
    c.add_argument("--mode", choices=("full", "db-only", "sample-only"), default="full")
    c.add_argument("-l", "--samples")
    c.add_argument("--genome-list")
    c.add_argument("--taxonomy")
    c.add_argument("-s", "--site", default="BcgI")
    c.add_argument("-t", "--level", default="species")
    c.add_argument("--outdir", "--od", required=True)
    c.add_argument("--database")
    c.add_argument("--pre-digested-dir")
    c.add_argument("-e", "--enzyme-file")
    c.add_argument("--gscore", type=float, default=5.0)
    c.add_argument("--gcf", type=int, default=1)
    c.add_argument("--min-gscore", type=float, default=0.0)
    c.add_argument("--min-taxon-percent", "--min-percent", dest="min_percent_taxon", type=float, default=0.0)
    c.add_argument("--resume", choices=_YES, default="no")
    c.add_argument("--prefix", default="Abundance_Stat")
    c.add_argument("--mock")
    c.add_argument("--control")
    c.add_argument("--ko-mapping")
    limits(c)
    reads(c)
    for c in sub.choices.values():
        c.add_argument("-j", "--threads", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("markerloom")
        # Threads are those of a session of one machine; a cluster's executors are set where it is started.
        spark = (builder.master(f"local[{a.threads}]") if a.threads and "MASTER" not in os.environ else builder).getOrCreate()
    fastx.register(spark)
    commands = {"extract": extract, "quantify": quantify, "find-genome": find_genome, "merge": merge, "predict": predict, "inspect": inspect_files, "pipeline": run_pipeline, "classify": classify, "convert-lineages": convert_lineages}
    if a.command.startswith("build-"):
        build_database(spark, a, a.command == "build-quan-db")
    else:
        commands[a.command](spark, a)
