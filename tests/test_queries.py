import inspect

import pytest

import __spark_entry__ as entry
import verify

#: One query of each kind; verify.py runs all of them on larger tables.
NAMES = ("digest_hin4i", "marker_all_levels", "abundance_full", "abundance_quantitative", "gcf_detected", "merge_pivot", "predict_long", "classify_features", "tag_hash_fx", "gtdb_parse", "database_theory", "abundance_tpch", "merged_samples", "p2_found", "p2_tags_by_listing", "p5_found")


@pytest.fixture(scope="module")
def con(sf):
    return verify.views(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    r = con.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert verify.rows(df.columns, df.collect()) == verify.rows(columns, r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "g_score" in df.columns


def test_every_sql_belongs_to_a_query():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert all(len(inspect.signature(f).parameters) == 2 for f in known.values())


def test_strands_of_whole_sequences(spark, sf, con):
    name = "revcomp_canonical"
    df = entry.queries()[name](spark, sf)
    r = con.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    got = df.collect()
    assert verify.rows(df.columns, got) == verify.rows(columns, r.fetchall())
    letters = con.execute("SELECT sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) FROM documents").fetchone()[0]
    assert sum(len(r["other_strand"]) for r in got) == sum(len(r["canonical"]) for r in got) == letters


def _ranks(ranks, genome):
    ranks = list(ranks)
    while len(ranks) < 8:
        ranks.append(f"{ranks[-1]} {genome}" if len(ranks) == 7 else f"{ranks[-1]}_strain")
    return "|".join(ranks)


def test_lineages_of_any_length_against_brute_force(spark, sf, con):
    want = set()
    for g, t in con.execute("SELECT DISTINCT gcf_id, taxonomy FROM genome_records WHERE gcf_id IS NOT NULL AND len(taxonomy) >= 1").fetchall():
        t = [x or "" for x in t]
        named = [x.strip() for x in t if x.strip()]
        strict = "|".join([*named[:7], f"{named[6]} {g}"]) if len(named) >= 7 else ""
        want.add((g, ";".join(f"{p}__{x}" for p, x in zip("dpcofgst", t)), _ranks(t, g), _ranks(t[:6], g), strict))
    got = [(r["gcf_id"], r["lineage"], r["ranks"], r["filled"], r["strict_ranks"]) for r in entry.queries()["gtdb_parse"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)
    lengths = {r[1].count(";") + 1 for r in got}
    assert min(lengths) < 6 and any(r[1].endswith("__") or "__;" in r[1] for r in got)
