"""Queries p1, p4, p6, p7, p8 and p9 over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, present, table
from . import distinct, mixing, overlap, packing, spam, topn


def _members(spark: SparkSession, d: str) -> DataFrame:
    """(kind, set, member) of problem 1; members as 64-bit values or strings hashed to such."""
    tasks = table(spark, d, "write_tasks")
    by_hash = tasks.select(F.lit("sample_hash").alias("kind"), F.col("sample").alias("set"), F.col("hash").alias("member")).where("member IS NOT NULL")
    by_id = tasks.where("id IS NOT NULL").select(F.lit("sample_id").alias("kind"), F.col("sample").alias("set"), F.xxhash64("id").alias("member"))
    records = present(table(spark, d, "compact_records").select("db_name", "gcf_index", "hash"))
    entries = present(table(spark, d, "compact_gcf_table").select("db_name", "gcf_index", "gcf_id")).distinct()
    species = present(table(spark, d, "genome_records").select("gcf_id", F.try_element_at("taxonomy", F.lit(7)).alias("set"))).distinct()
    by_species = records.join(entries.join(species, "gcf_id"), ["db_name", "gcf_index"]).select(F.lit("species").alias("kind"), "set", F.col("hash").alias("member"))
    return by_hash.unionByName(by_id).unionByName(by_species)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlap_sizes(_members(spark, d), min_share=0.3, min_size=40)
    return pairs.select("kind", "set_a", "set_b")


def p1_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share at least a tenth of the smaller set, with the estimated sizes of the three parts of their union and the standard error."""
    return overlap.overlap_sizes(_members(spark, d), min_share=0.1, min_size=40)


def p1_estimates_check(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of problem 1 with their exact number of shared members, and whether the estimate lies within five standard errors (and one member) of it."""
    members = _members(spark, d)
    est = overlap.overlap_sizes(members, min_share=0.3, min_size=40).select("kind", "set_a", "set_b", F.col("shared").alias("estimate"), "shared_error")
    exact = overlap.shared_counts(members).select("kind", "set_a", "set_b", "shared")
    return est.join(exact, ["kind", "set_a", "set_b"]).select("kind", "set_a", "set_b", "shared", (F.abs(F.col("estimate") - F.col("shared")) <= 5 * F.col("shared_error") + 1).alias("within"))


def p1_overlap_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that shares at least one member, with the exact sizes of the three parts of its union."""
    return overlap.shared_counts(_members(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    theory = table(spark, d, "gcf_theory").select(F.lit("gcf_theory").alias("ref_table"), F.col("taxon").alias("grp"), F.col("gcf_id").alias("item_key"), F.col("gcf_unique_tag_count").alias("score"))
    stats = table(spark, d, "abundance_stats").select(F.lit("abundance_stats").alias("ref_table"), F.col("sample").alias("grp"), F.col("taxon").alias("item_key"), F.col("sequenced_reads_num").alias("score"))
    return theory.unionByName(stats)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_scored(spark, d), ["ref_table", "grp"], "item_key", "score", 5).select("ref_table", "grp", "item_key", "rnk")


def p4_top_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same with the scores, for 20 items of a group."""
    return topn.top_n(_scored(spark, d), ["ref_table", "grp"], "item_key", "score", 20).select("ref_table", "grp", "item_key", "score", "rnk")


def _day(column: str):
    return F.col(column).cast("date").cast("string").alias("cell_day")


#: No cell's ratio lies between these; 512 registers put six standard errors of the count between the cut and either.
P6_RATIOS = (0.29, 0.5)
CELLS = distinct.SketchConfig(m=512)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "write_tasks").select(F.lit("hash").alias("kind"), _day("extracted_at"), F.col("sample").alias("grp"), F.col("hash").alias("member"))
    genomes = table(spark, d, "gcf_theory").select(F.lit("gcf_id").alias("kind"), _day("built_at"), F.col("db_name").alias("grp"), F.xxhash64("gcf_id").alias("member"), F.col("gcf_id").isNull().alias("gone"))
    rows = tags.unionByName(genomes.where("NOT gone").drop("gone"))
    cut, _ = distinct.cut_between(*P6_RATIOS, CELLS)
    return distinct.repeated_cells(rows, ["kind", "cell_day", "grp"], "member", 20, cut, CELLS).select("kind", "cell_day", "grp")


def _tag_cells(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "write_tasks").select(_day("extracted_at"), "sample", "enzyme", "hash")
    return distinct.sketch(tags, ["cell_day", "sample", "enzyme"], "hash", null_keys=True)


def p6_distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tags for each day, sample, enzyme and combination of these, all rolled up from the finest sketches.

    A row with a null key counts in every cell in which that key plays no part.
    """
    return distinct.with_counts(distinct.cube(_tag_cells(spark, d), ["cell_day", "sample", "enzyme"])).drop("registers")


def p6_distinct_genomes(spark: SparkSession, d: str) -> DataFrame:
    """Distinct genomes for each day, database and both; null keys as of :func:`p6_distinct_tags`."""
    rows = table(spark, d, "gcf_theory").select(_day("built_at"), "db_name", "gcf_id")
    return distinct.with_counts(distinct.cube(distinct.sketch(rows, ["cell_day", "db_name"], "gcf_id", null_keys=True), ["cell_day", "db_name"])).drop("registers")


#: Neighbouring days share about a hundredth of their tags; days are few, so their sketches may be large. Standard error of a small Jaccard coefficient about 0.003.
DAYS = distinct.SketchConfig(m=4096)


def p6_day_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each day's distinct tags against those of the day before: union, shared tags and Jaccard coefficient."""
    tags = table(spark, d, "write_tasks").select(_day("extracted_at"), "hash")
    days = distinct.sketch(tags, ["cell_day"], "hash", DAYS)
    before = days.select(F.date_add(F.col("cell_day").cast("date"), 1).cast("string").alias("cell_day"), F.col("registers").alias("registers_b"))
    return distinct.joint_counts(days.select("cell_day", F.col("registers").alias("registers_a")).join(before, "cell_day"), DAYS)


#: Estimates are checked to lie within this many standard errors of the exact numbers; there are some ten thousand cells.
CHECK_ERRORS = 6


def _within(estimates: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (of which some may be null), exact distinct members and whether the estimate is near enough."""
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys]
    off = F.abs(F.col("e.n_distinct") - F.col("x.n_exact"))
    return exact.alias("x").join(estimates.alias("e"), same).select(*[F.col(f"x.{k}") for k in keys], "x.n_exact", (off <= CHECK_ERRORS * F.col("e.rel_error") * F.col("x.n_exact")).alias("within"))


def _exact_cube(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Exact distinct members of every combination of keys, as :func:`distinct.cube` estimates them."""
    rows = rows.where(F.col(member).isNotNull())
    out = None
    for bits in range(1, 2 ** len(keys)):
        own = [k for i, k in enumerate(keys) if bits >> i & 1]
        cells = present(rows.select(*own, member), *own).distinct().groupBy(*own).agg(F.count(F.lit(1)).alias("n_exact"))
        cells = cells.select(*[F.col(k) if k in own else F.lit(None).cast("string").alias(k) for k in keys], "n_exact")
        out = cells if out is None else out.unionByName(cells)
    return out


def p6_distinct_tags_check(spark: SparkSession, d: str) -> DataFrame:
    """The cells of :func:`p6_distinct_tags` with their exact numbers, and whether the estimates are within six standard errors of them."""
    keys = ["cell_day", "sample", "enzyme"]
    rows = table(spark, d, "write_tasks").select(_day("extracted_at"), "sample", "enzyme", "hash")
    return _within(p6_distinct_tags(spark, d), _exact_cube(rows, keys, "hash"), keys)


def p6_distinct_genomes_check(spark: SparkSession, d: str) -> DataFrame:
    """The same for :func:`p6_distinct_genomes`."""
    keys = ["cell_day", "db_name"]
    rows = table(spark, d, "gcf_theory").select(_day("built_at"), "db_name", "gcf_id")
    return _within(p6_distinct_genomes(spark, d), _exact_cube(rows, keys, "gcf_id"), keys)


def p6_day_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    """Each day's exact Jaccard coefficient with the day before, and whether the estimate of :func:`p6_day_overlap` is within six of its standard errors."""
    tags = present(table(spark, d, "write_tasks").select(_day("extracted_at"), "hash")).distinct()
    sizes = tags.groupBy("cell_day").agg(F.count(F.lit(1)).alias("n"))
    after = lambda df, n: df.withColumn("cell_day", F.date_add(F.col("cell_day").cast("date"), 1).cast("string")).withColumnRenamed("n", n)
    shared = tags.join(after(tags, "n_b"), ["cell_day", "hash"]).groupBy("cell_day").agg(F.count(F.lit(1)).alias("shared"))
    days = sizes.withColumnRenamed("n", "n_a").join(after(sizes, "n_b"), "cell_day").join(shared, "cell_day", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    exact = days.select("cell_day", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("exact"))
    both = exact.join(p6_day_overlap(spark, d), "cell_day")
    return both.select("cell_day", "shared", (F.abs(F.col("jaccard") - F.col("exact")) <= CHECK_ERRORS * F.col("jaccard_error")).alias("within"))


def _capacity(spark: SparkSession, d: str) -> int:
    return table(spark, d, "containers").select("capacity_tokens").first()[0]  # one row at every scale


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_documents(packing.pack(table(spark, d, "documents"), _capacity(spark, d)))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), _capacity(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    capacity = _capacity(spark, d)
    return packing.container_fill(packing.pack(table(spark, d, "documents"), capacity), capacity)


def p7_packing_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents packed, containers over the capacity, documents cut although they fit, and whether there are at most 1 % more containers than the tokens need."""
    capacity = _capacity(spark, d)
    packed = materialize(packing.pack(table(spark, d, "documents"), capacity), "packed")
    none = F.lit(0).cast("bigint")
    pieces = packed.agg(F.count_if(F.col("piece") == 0).alias("n_docs"), F.count_if((F.col("piece") > 0) & (F.col("token_from") != F.col("piece") * capacity)).alias("cut_needlessly"))
    fill = packing.container_fill(packed, capacity).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > capacity).alias("over_full"))
    rows = pieces.select("n_docs", "cut_needlessly", none.alias("n"), none.alias("tokens"), none.alias("over_full")).unionByName(fill.withColumns({"n_docs": none, "cut_needlessly": none}))
    total = rows.agg(*[F.coalesce(F.sum(c), none).alias(c) for c in rows.columns])
    return total.select("n_docs", "over_full", "cut_needlessly", (F.col("n") <= F.ceil(F.col("tokens") / capacity) * 1.01 + 1).alias("dense"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    report = mixing.mix_report(mixing.measure(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return report.where("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.measure(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(mixing.measure(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_shares_check(spark: SparkSession, d: str) -> DataFrame:
    """For each target source whether it falls short, and whether the mix is as wanted: all it has, ``max_repeats`` times, if it does, else its budget to within its longest document."""
    counted = mixing.measure(table(spark, d, "documents"))
    report = mixing.mix_report(counted, table(spark, d, "mix_targets"))
    longest = counted.groupBy("source").agg(F.max("tokens").alias("longest"))
    whole = F.col("mix_tokens") == F.col("max_repeats") * F.col("source_tokens")
    near = F.abs(F.col("mix_tokens") - F.col("budget_tokens")) <= F.coalesce("longest", F.lit(0))
    wanted = F.when(F.col("short"), whole).otherwise(near) & (F.col("epochs") <= F.col("max_repeats"))
    return report.join(longest, "source", "left").select("source", "target_share", "max_repeats", "short", wanted.alias("as_wanted"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_messages(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of the trees, rate of the sender's host and smoothed score of every message."""
    return spam.score_messages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_overlap_sizes, p1_estimates, p1_estimates_check, p4_found, p4_top_scores, p6_found, p6_distinct_tags, p6_distinct_genomes, p6_day_overlap, p6_distinct_tags_check, p6_distinct_genomes_check, p6_day_overlap_check, p7_found, p7_containers, p7_fill, p7_packing_check, p8_found, p8_mix, p8_shares, p8_shares_check, p9_found, p9_scores)}
