"""Queries p2, p3 and p5 over the driver's tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eager, orphans, rejects
from ..session import table

#: Share of a table's rows from which a taxon is crowded.
CROWDED = 0.05


def _species():
    return F.try_element_at("taxonomy", F.lit(7))


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return eager.crowded_key_profile(table(spark, d, "gcf_theory"), table(spark, d, "genome_records"), F.col("taxon"), _species(), {"tags": "gcf_unique_tag_count"}, CROWDED, ("theory", "records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.crowded_keys(_profile(spark, d), {"theory": "gcf_theory", "records": "genome_records"}, "taxon")


def p2_taxa(spark: SparkSession, d: str) -> DataFrame:
    """Every taxon's rows in both tables, the rows and tag sum of their join, tag sum and mean, shares and flags."""
    shares = [F.round(f"share_{s}", 9).alias(f"share_{s}") for s in ("theory", "records")]
    return _profile(spark, d).select(F.col("key").alias("taxon"), "n_theory", "n_records", "n_join", "tags_sum", "tags_cnt", "tags_mean", "tags_join_sum", *shares, "crowded_theory", "crowded_records")


def p2_tags_by_listing(spark: SparkSession, d: str) -> DataFrame:
    """Theory rows joined with the genomes' listings by genome, summed for each listed species."""
    theory, records = table(spark, d, "gcf_theory"), table(spark, d, "genome_records")
    sums = eager.eager_join_aggregate(theory, records, {"gcf_id": ("gcf_id", "gcf_id")}, {}, {"species": F.coalesce(_species(), F.lit(""))}, {"tags": "gcf_unique_tag_count"})
    return sums.withColumn("tags_mean", F.round(F.try_divide(F.col("tags_sum").cast("double"), F.col("tags_cnt")), 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected_lines(rejects.parse_genome_lines(table(spark, d, "raw_genome_lines"))).select("line_id", "reason")


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    return rejects.valid_records(rejects.parse_genome_lines(table(spark, d, "raw_genome_lines"))).withColumn("taxonomy", F.concat_ws("|", "taxonomy"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    month = F.substring(F.col("at").cast("date").cast("string"), 1, 7).alias("ref_month")
    theory = table(spark, d, "gcf_theory").select(F.lit("gcf_theory").alias("ref_table"), F.col("theory_id").alias("ref_id"), "gcf_id", F.col("built_at").alias("at"))
    entries = table(spark, d, "compact_gcf_table")
    by_entry = entries.select(F.lit("compact_gcf_table").alias("ref_table"), F.col("entry_id").alias("ref_id"), "gcf_id", F.col("written_at").alias("at"))
    genomes = orphans.orphans_in_time(theory.unionByName(by_entry), table(spark, d, "genome_records"), "gcf_id", "at", "recorded_at", "deleted_at")
    records = table(spark, d, "compact_records").select(F.col("record_id").alias("ref_id"), "db_name", "gcf_index", F.col("written_at").alias("at"))
    lost = orphans.orphan_rows(records, entries, ["db_name", "gcf_index"])
    lost = lost.select(F.lit("compact_records").alias("ref_table"), "ref_id", month, F.lit("missing").alias("status"))
    return genomes.select("ref_table", "ref_id", month, "status").unionByName(lost)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d).distinct())


QUERIES = {f.__name__: f for f in (p2_found, p2_taxa, p2_tags_by_listing, p3_found, p3_valid, p5_found, p5_counts)}

_P2 = """
WITH a AS (SELECT coalesce(taxon, '') AS taxon, count(*) AS n, sum(gcf_unique_tag_count)::BIGINT AS s, count(gcf_unique_tag_count) AS c FROM gcf_theory GROUP BY 1),
b AS (SELECT coalesce(taxonomy[7], '') AS taxon, count(*) AS n FROM genome_records GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM gcf_theory) AS ta, (SELECT count(*) FROM genome_records) AS tb),
p AS (
  SELECT coalesce(a.taxon, b.taxon) AS taxon, coalesce(a.n, 0)::BIGINT AS n_theory, coalesce(b.n, 0)::BIGINT AS n_records, s AS tags_sum, coalesce(c, 0)::BIGINT AS tags_cnt, round(s::DOUBLE / nullif(c, 0), 6) AS tags_mean,
    coalesce(a.n, 0) / ta AS sa, coalesce(b.n, 0) / tb AS sb, CASE WHEN coalesce(a.taxon, b.taxon) = '' THEN 0 ELSE coalesce(b.n, 0) END AS m
  FROM a FULL JOIN b ON a.taxon = b.taxon, t)
"""

_P5 = """
WITH refs AS (
  SELECT DISTINCT 'gcf_theory' AS ref_table, theory_id AS ref_id, gcf_id, built_at AS t FROM gcf_theory WHERE gcf_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'compact_gcf_table', entry_id, gcf_id, written_at FROM compact_gcf_table WHERE gcf_id IS NOT NULL),
j AS (
  SELECT r.ref_table, r.ref_id, r.t, r.gcf_id, count(g.gcf_id) AS n, coalesce(bool_or(g.recorded_at <= r.t AND (g.deleted_at IS NULL OR g.deleted_at > r.t)), false) AS alive, coalesce(bool_and(g.recorded_at > r.t), false) AS late
  FROM refs r LEFT JOIN genome_records g ON g.gcf_id = r.gcf_id GROUP BY ALL),
f AS (
  SELECT ref_table, ref_id, strftime(t, '%Y-%m') AS ref_month, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS status FROM j WHERE n = 0 OR NOT alive
  UNION SELECT 'compact_records', record_id, strftime(written_at, '%Y-%m'), 'missing' FROM compact_records r
  WHERE db_name IS NOT NULL AND gcf_index IS NOT NULL AND NOT EXISTS (SELECT 1 FROM compact_gcf_table e WHERE e.db_name = r.db_name AND e.gcf_index = r.gcf_index))
"""

# Fields by a regular expression: quoted as a whole, or without any quote.
_P3 = r"""
WITH t AS (SELECT *, trim(regexp_replace(trim(line, ' '), '\r\z', ''), ' ') AS x FROM raw_genome_lines),
f AS (
  SELECT *, regexp_full_match(x, '(?s)( *"([^"]|"")*" *|[^"\t]*)(\t( *"([^"]|"")*" *|[^"\t]*))*') AS quoted, regexp_extract_all(x || chr(9), '(?s)( *"(?:[^"]|"")*" *|[^"\t]*)\t', 1) AS raw
  FROM t WHERE regexp_matches(x, '[^ \t]') AND NOT starts_with(x, '#')),
v AS (SELECT *, [trim(CASE WHEN starts_with(trim(y, ' '), '"') THEN replace(substr(trim(y, ' '), 2, length(trim(y, ' ')) - 2), '""', '"') ELSE y END, ' ') FOR y IN raw] AS p FROM f),
r AS (
  SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(p) NOT IN (9, 10) THEN 'column_count'
    WHEN NOT regexp_full_match(p[1], 'GC[FA]_[0-9]{9}\.[0-9]+') OR list_bool_or([y = '' OR regexp_matches(y, '[\x{00}-\x{08}\x{0A}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]') FOR y IN p[2:9]])
      OR (len(p) = 10 AND p[10] <> '' AND NOT regexp_full_match(p[10], '(?s).*\.(fa|fna|fasta)(\.gz)?')) THEN 'invalid_value' END AS reason FROM v)
"""

SQL = {
    "p3_found": _P3 + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p3_valid": _P3 + "SELECT line_id, list_file, received_at, p[1] AS gcf_id, array_to_string(p[2:9], '|') AS taxonomy, nullif(p[10], '') AS genome_path FROM r WHERE reason IS NULL",
    "p2_found": _P2 + "SELECT 'gcf_theory' AS ref_table, taxon FROM p WHERE sa >= 0.05 UNION ALL SELECT 'genome_records', taxon FROM p WHERE sb >= 0.05",
    "p2_taxa": _P2 + """SELECT taxon, n_theory, n_records, (n_theory * m)::BIGINT AS n_join, tags_sum, tags_cnt, tags_mean, (tags_sum * m)::BIGINT AS tags_join_sum,
      round(sa, 9) AS share_theory, round(sb, 9) AS share_records, sa >= 0.05 AS crowded_theory, sb >= 0.05 AS crowded_records FROM p""",
    "p2_tags_by_listing": """SELECT coalesce(taxonomy[7], '') AS species, count(*) AS n_rows, sum(gcf_unique_tag_count)::BIGINT AS tags_sum, count(gcf_unique_tag_count) AS tags_cnt, round(avg(gcf_unique_tag_count), 6) AS tags_mean
      FROM gcf_theory t JOIN genome_records g ON t.gcf_id = g.gcf_id GROUP BY 1""",
    "p5_found": _P5 + "SELECT DISTINCT ref_table, ref_id, ref_month, status FROM f",
    "p5_counts": _P5 + "SELECT ref_table, ref_month, status, count(*) AS n_refs FROM (SELECT DISTINCT * FROM f) GROUP BY ALL",
}
