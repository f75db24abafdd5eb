"""The tag operators on tables that hold tags already: compact databases and read tags, and orders as tags at bench scale.

In the order tables an order is a tag, a supplier a genome, its region the taxon, a line a read, and customers fall into four samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import markers, matrix, profile
from ..session import materialize, present, table

SAMPLES = ("s0", "s1", "s2", "s3")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gcf_id"), F.col("s_nationkey").alias("n_nationkey"))
    return suppliers.join(nations, "n_nationkey").select("gcf_id", F.array(F.col("n_regionkey").cast("string")).alias("taxonomy"))


def _order_markers(spark, d) -> DataFrame:
    tags = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gcf_id"), F.col("l_orderkey").alias("tag"))
    return markers.unique_markers(markers.tag_occurrences(tags, _regions(spark, d), ["kingdom"]))


def _order_profile(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tag"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("tag"), F.concat(F.lit("s"), F.pmod("o_custkey", F.lit(4)).cast("string")).alias("sample"))
    # Depth per order first: the sample of an order is joined to one row instead of all its lines.
    counts = lines.groupBy("tag").agg(F.count(F.lit(1)).alias("depth")).join(orders, "tag")
    m = materialize(_order_markers(spark, d), "markers")
    return profile.abundance(counts.groupBy("sample", "tag").agg(F.sum("depth").alias("depth")), m, markers.taxon_theory(m))


_RATIOS = ("theoretical_tag_num", "percent", "reads_per_theoretical", "reads_per_sequenced", "g_score", "relative_abundance")


def _rounded(df: DataFrame, columns=_RATIOS) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def marker_tpch(spark, d):
    return _order_markers(spark, d).select("tag", "gcf_id", "taxon")


def abundance_tpch(spark, d):
    return _rounded(_order_profile(spark, d))


def gscore_tpch(spark, d):
    return _order_profile(spark, d).where("g_score >= 60").select("sample", "taxon", F.round("g_score", 6).alias("g_score"))


def _long(spark, d):
    return matrix.normalise(_order_profile(spark, d))


def merge_tpch_pivot(spark, d):
    return _rounded(matrix.pivot(_long(spark, d), SAMPLES), SAMPLES)


def predict_tpch(spark, d):
    part = table(spark, d, "part")
    mapping = part.groupBy(F.pmod("p_partkey", F.lit(5)).cast("string").alias("species"), F.col("p_type").alias("function")).agg(F.count(F.lit(1)).alias("copies"))
    return _rounded(matrix.predict(_long(spark, d), mapping), ["value"])


def _listed(spark, d) -> DataFrame:
    """The lineage of each genome's last listing."""
    return markers.latest_listing(table(spark, d, "genome_records"), "gcf_id", ["recorded_at", F.concat_ws("|", "taxonomy")], "taxonomy")


def _db_tags(spark, d) -> DataFrame:
    """(db_name, tag, gcf_id) of the compact databases; repeated rows once."""
    records = table(spark, d, "compact_records").distinct().select("db_name", "gcf_index", F.col("hash").alias("tag"))
    entries = present(table(spark, d, "compact_gcf_table").select("db_name", "gcf_index", "gcf_id")).distinct()
    return records.join(entries, ["db_name", "gcf_index"]).select("db_name", "tag", "gcf_id")


def _db_markers(spark, d, levels=("species",)) -> DataFrame:
    return markers.unique_markers(markers.tag_occurrences(_db_tags(spark, d), _listed(spark, d), levels, ["db_name"]), ["db_name"])


def database_markers(spark, d):
    """Markers of every compact database at all eight ranks: tags, genomes and taxa of each."""
    found = _db_markers(spark, d, tx.RANKS)
    return found.groupBy("db_name", "level").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("tag").alias("n_tags"), F.count_distinct("gcf_id").alias("n_genomes"), F.count_distinct("taxon").alias("n_taxa"))


def database_theory(spark, d):
    t = markers.taxon_theory(_db_markers(spark, d), ["db_name"])
    return t.select("db_name", "taxon", F.round("theoretical_tag_num", 6).alias("theoretical_tag_num"), "n_genomes")


def sample_tag_depth(spark, d):
    """Read tags of each sample and enzyme: tags, reads, tags with more than one read. Repeated rows are the same read."""
    tags = table(spark, d, "write_tasks").select("sample", "enzyme", "id", F.col("hash").alias("tag")).distinct()
    depth = profile.tag_depth(tags, ["sample", "enzyme"])
    return depth.groupBy("sample", "enzyme").agg(F.count(F.lit(1)).alias("n_tags"), F.sum("depth").alias("n_reads"), F.count_if(F.col("depth") > 1).alias("n_tags_gt1"))


def merged_samples(spark, d):
    """Abundance tables of many samples merged: of each sample and taxon the last run counts; shares of the sample's reads per theoretical tag, without the taxa of control samples."""
    stats = table(spark, d, "abundance_stats").where("sample IS NOT NULL AND taxon IS NOT NULL")
    last = stats.groupBy("sample", "enzyme", "taxon").agg(F.max_by(F.struct("sequenced_reads_num", "theoretical_tag_num"), F.struct("run_at", "stat_id")).alias("s")).select("sample", "taxon", "s.*")
    ratio = F.coalesce(F.try_divide(F.col("sequenced_reads_num").cast("double"), F.col("theoretical_tag_num")), F.lit(0.0))
    per = last.groupBy("sample", "taxon").agg(F.sum(ratio).alias("reads_per_theoretical"))
    long = matrix.normalise(per)
    is_control = F.col("sample").startswith("ctl-")
    clean = matrix.without_contamination(long, is_control).select("taxon", "sample", F.lit(True).alias("clean"))
    all_samples = long.where(~is_control).join(clean, ["taxon", "sample"], "left")
    return all_samples.select("taxon", "sample", F.round("value", 6).alias("value"), F.col("clean").isNull().alias("contaminated"))


QUERIES = {f.__name__: f for f in (marker_tpch, abundance_tpch, gscore_tpch, merge_tpch_pivot, predict_tpch, database_markers, database_theory, sample_tag_depth, merged_samples)}

_M = """WITH o AS (SELECT l_orderkey AS tag, l_suppkey AS gcf_id, n_regionkey::VARCHAR AS taxon, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
m AS (SELECT * FROM o WHERE n = 1 AND tag IN (SELECT tag FROM o GROUP BY tag HAVING count(DISTINCT taxon) = 1))"""
_P = _M + """, th AS (SELECT taxon, avg(c) AS e FROM (SELECT taxon, gcf_id, sum(n) AS c FROM m GROUP BY ALL) GROUP BY 1),
r AS (SELECT 's' || (o_custkey % 4) AS sample, l_orderkey AS tag, count(*) AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
a0 AS (SELECT sample, taxon, count(*) AS t, sum(depth)::BIGINT AS r, count(*) FILTER (depth > 1) AS t1 FROM r JOIN (SELECT DISTINCT tag, taxon FROM m) USING (tag) GROUP BY ALL),
a AS (SELECT sample, taxon, e AS theoretical_tag_num, t AS sequenced_tag_num, t / e * 100 AS percent, r AS sequenced_reads_num, r / e AS reads_per_theoretical, r / t AS reads_per_sequenced, t1 AS sequenced_tag_num_gt1, sqrt(t * r) AS g_score,
  r / sum(r) OVER (PARTITION BY sample) * 100 AS relative_abundance FROM a0 JOIN th USING (taxon)),
v AS (SELECT taxon, sample, reads_per_theoretical / sum(reads_per_theoretical) OVER (PARTITION BY sample) AS value FROM a)"""
_D = """WITH g0 AS (SELECT gcf_id, taxonomy, row_number() OVER (PARTITION BY gcf_id ORDER BY recorded_at DESC NULLS LAST, coalesce(array_to_string(list_filter(taxonomy, lambda x: x IS NOT NULL), '|'), '') DESC) AS k FROM genome_records WHERE gcf_id IS NOT NULL),
l AS (SELECT * FROM (VALUES (1, 'kingdom'), (2, 'phylum'), (3, 'class'), (4, 'order'), (5, 'family'), (6, 'genus'), (7, 'species'), (8, 'strain')) l(n, level)),
t AS (SELECT gcf_id, level, array_to_string(taxonomy[1:n], chr(9)) AS taxon FROM g0, l WHERE k = 1 AND len(taxonomy) >= n AND len(list_filter(taxonomy[1:n], lambda x: x IS NULL)) = 0),
c AS (SELECT r.db_name, r.hash AS tag, e.gcf_id, count(*) AS n FROM (SELECT DISTINCT * FROM compact_records) r JOIN (SELECT DISTINCT db_name, gcf_index, gcf_id FROM compact_gcf_table WHERE gcf_id IS NOT NULL) e
  ON r.db_name = e.db_name AND r.gcf_index = e.gcf_index WHERE r.hash IS NOT NULL GROUP BY ALL),
o AS (SELECT db_name, level, tag, gcf_id, taxon, n FROM c JOIN t USING (gcf_id)),
m AS (SELECT o.* FROM o JOIN (SELECT db_name, level, tag FROM o GROUP BY ALL HAVING count(DISTINCT taxon) = 1) USING (db_name, level, tag) WHERE n = 1)"""

SQL = {
    "marker_tpch": _M + " SELECT tag, gcf_id, taxon FROM m",
    "abundance_tpch": _P + " SELECT sample, taxon, sequenced_tag_num, sequenced_reads_num, sequenced_tag_num_gt1, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATIOS) + " FROM a",
    "gscore_tpch": _P + " SELECT sample, taxon, round(g_score, 6) AS g_score FROM a WHERE g_score >= 60",
    "merge_tpch_pivot": _P + " SELECT taxon, " + ", ".join(f"round(coalesce(sum(value) FILTER (sample = '{s}'), 0), 6) AS {s}" for s in SAMPLES) + " FROM v GROUP BY taxon HAVING max(value) > 0",
    "predict_tpch": _P + """, k AS (SELECT (p_partkey % 5)::VARCHAR AS taxon, p_type AS function, count(*) AS copies FROM part GROUP BY ALL), f AS (SELECT sample, function, sum(value * copies) AS x FROM v JOIN k USING (taxon) GROUP BY ALL)
      SELECT function, sample, round(x / sum(x) OVER (PARTITION BY sample), 6) AS value FROM f""",
    "database_markers": _D + " SELECT db_name, level, count(*) AS n_records, count(DISTINCT tag) AS n_tags, count(DISTINCT gcf_id) AS n_genomes, count(DISTINCT taxon) AS n_taxa FROM m GROUP BY ALL",
    "database_theory": _D + " SELECT db_name, taxon, round(avg(s), 6) AS theoretical_tag_num, count(*) AS n_genomes FROM (SELECT db_name, taxon, gcf_id, sum(n) AS s FROM m WHERE level = 'species' GROUP BY ALL) GROUP BY ALL",
    "sample_tag_depth": """SELECT sample, enzyme, count(*) AS n_tags, sum(d)::BIGINT AS n_reads, count(*) FILTER (d > 1) AS n_tags_gt1 FROM (SELECT sample, enzyme, hash, count(*) AS d FROM (SELECT DISTINCT sample, enzyme, id, hash FROM write_tasks)
      WHERE sample IS NOT NULL AND enzyme IS NOT NULL AND hash IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "merged_samples": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY sample, enzyme, taxon ORDER BY run_at DESC NULLS LAST, stat_id DESC NULLS LAST) AS k FROM abundance_stats WHERE sample IS NOT NULL AND taxon IS NOT NULL),
      p AS (SELECT sample, taxon, sum(coalesce(sequenced_reads_num / nullif(theoretical_tag_num, 0), 0)) AS x FROM s WHERE k = 1 GROUP BY ALL), n AS (SELECT sample, taxon, x, sum(x) OVER (PARTITION BY sample) AS t FROM p),
      v AS (SELECT taxon, sample, CASE WHEN t > 0 THEN x / t ELSE x END AS value FROM n)
      SELECT taxon, sample, round(value, 6) AS value, taxon IN (SELECT taxon FROM v WHERE sample LIKE 'ctl-%' AND value > 0) AS contaminated FROM v WHERE sample NOT LIKE 'ctl-%'""",
}
