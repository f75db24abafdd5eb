import pytest
from pyspark.sql import functions as F

import verify
from markerloom.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, sf, name):
    if name.startswith("p8"):  # letters stand for tokens there, which a hundred documents are too few for
        sf = sf.replace("0.001", "0.01")
    df = queries.QUERIES[name](spark, sf)
    r = verify.views(sf).execute(sql.SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert verify.rows(df.columns, df.collect()) == verify.rows(columns, r.fetchall())


@pytest.mark.parametrize("name", ["p6_distinct_tags", "p6_distinct_genomes", "p6_day_overlap", "p1_estimates", "p7_containers", "p7_fill", "p8_mix", "p8_shares", "p9_found", "p9_scores"])
def test_query_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_distinct_tags_against_exact_counts(spark, sf):
    con = verify.views(sf)
    exact = dict(con.execute("SELECT sample, count(DISTINCT hash) FROM write_tasks WHERE sample IS NOT NULL AND hash IS NOT NULL AND extracted_at IS NOT NULL GROUP BY 1").fetchall())
    got = {r["sample"]: r["n_distinct"] for r in queries.p6_distinct_tags(spark, sf).where("cell_day IS NULL AND enzyme IS NULL").collect()}
    assert set(got) == set(exact)
    assert all(abs(got[s] - n) < 5 * 0.063 * n for s, n in exact.items())


@pytest.mark.parametrize(("name", "columns", "member", "source"), [
    ("p6_distinct_tags", {"cell_day": "strftime(extracted_at, '%Y-%m-%d')", "sample": "sample", "enzyme": "enzyme"}, "hash", "write_tasks"),
    ("p6_distinct_genomes", {"cell_day": "strftime(built_at, '%Y-%m-%d')", "db_name": "db_name"}, "gcf_id", "gcf_theory"),
])
def test_cells_have_all_rows_that_have_their_keys(spark, sf, name, columns, member, source):
    con, keys = verify.views(sf), list(columns)
    exact = {}
    for bits in range(1, 2 ** len(keys)):
        own = [k for i, k in enumerate(keys) if bits >> i & 1]
        select = ", ".join(columns[k] if k in own else "NULL" for k in keys)
        there = " AND ".join(f"{c} IS NOT NULL" for c in [member, *[columns[k] for k in own]])
        exact |= {tuple(r[:-1]): r[-1] for r in con.execute(f"SELECT {select}, count(*) FROM {source} WHERE {there} GROUP BY ALL").fetchall()}
    assert {tuple(r[k] for k in keys): r["n_rows"] for r in queries.QUERIES[name](spark, sf).collect()} == exact


def test_day_overlap_tells_small_overlaps_from_none(spark, tmp_path):
    """At the query's own setting: 2,000 tags a day, 40 of them (a Jaccard coefficient of 0.01) those of the day before, none from the 16th day on."""
    rows = spark.range(30 * 2000).select((F.col("id") / 2000).cast("int").alias("day"), (F.col("id") % 2000).alias("i"))
    step = F.when(F.col("day") < 15, 1960).otherwise(2000)
    rows.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("timestamp").alias("extracted_at"), (F.col("day") * step + F.col("i")).cast("bigint").alias("hash")).write.parquet(f"{tmp_path}/write_tasks.parquet")
    got = sorted(queries.p6_day_overlap(spark, str(tmp_path)).collect(), key=lambda r: r["cell_day"])
    assert len(got) == 29
    shared, none = got[:14], got[15:]
    for r, j in [(r, 40 / 3960) for r in shared] + [(r, 0.0) for r in none]:
        assert abs(r["jaccard"] - j) < 4 * r["jaccard_error"] and r["jaccard_error"] < 0.005
    mean = lambda rs: sum(r["n_shared"] for r in rs) / len(rs)
    assert 28 < mean(shared) < 52 and mean(none) < 14
