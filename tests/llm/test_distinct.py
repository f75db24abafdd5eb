import numpy as np
from pyspark.sql import functions as F

from markerloom.llm import distinct

CONFIG = distinct.SketchConfig()


def test_counts_within_the_stated_error(spark):
    sizes = [1, 3, 40, 700, 20_000]
    df = spark.range(sum(sizes)).withColumn("cell", F.when(F.col("id") < 1, 0).when(F.col("id") < 4, 1).when(F.col("id") < 44, 2).when(F.col("id") < 744, 3).otherwise(4))
    df = df.union(df).withColumn("member", F.lit("clash")).withColumn("registers", F.lit(1)).withColumn("gone", F.lit(1)).repartition(5)
    got = {r["cell"]: r for r in distinct.with_counts(distinct.sketch(df, ["cell"], "id")).collect()}
    for i, n in enumerate(sizes):
        r = got[str(i)]
        assert r["n_rows"] == 2 * n and abs(r["n_distinct"] - n) < 4 * CONFIG.error * n
        assert r["rel_error"] == CONFIG.error and len(r["registers"]) == CONFIG.m


def test_error_over_many_sets():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        low = np.full((1, CONFIG.m), np.uint64(2**64 - 1))
        distinct._lowest(np.zeros(3000, dtype=np.int64), rng.integers(0, 2**64, 3000, dtype=np.uint64), CONFIG.m, low)
        errors.append(distinct.estimate_counts(distinct._registers(low, CONFIG), CONFIG)[0] / 3000 - 1)
    assert abs(np.mean(errors)) < 0.03 and 0.7 * CONFIG.error < np.std(errors) < 1.35 * CONFIG.error


def test_merging_equals_sketching_at_once(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), (F.col("id") % 4).alias("b"), (F.col("id") % 900).alias("x"))
    whole = {r["a"]: bytes(r["registers"]) for r in distinct.sketch(df, ["a"], "x").collect()}
    fine = distinct.sketch(df, ["a", "b"], "x")
    merged = {r["a"]: (bytes(r["registers"]), r["n_rows"]) for r in distinct.merge_sketches(fine, ["a"]).collect()}
    assert {k: v[0] for k, v in merged.items()} == whole and sum(v[1] for v in merged.values()) == 5000
    later = distinct.merge_sketches(distinct.sketch(df.where("x < 400"), ["a"], "x").unionByName(distinct.sketch(df.where("x >= 300"), ["a"], "x")), ["a"])
    assert {r["a"]: bytes(r["registers"]) for r in later.collect()} == whole
    cells = distinct.cube(fine, ["a", "b"]).collect()
    assert len(cells) == 3 + 4 + 12 and {r["a"]: bytes(r["registers"]) for r in cells if r["b"] is None} == whole


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None), (None, "x"), ("", ""), ("a", "y" * 50_000)], "k STRING, x STRING")
    got = {r["k"]: r["n_rows"] for r in distinct.sketch(df, ["k"], "x").collect()}
    assert got == {"": 1, "a": 1}
    assert distinct.with_counts(distinct.sketch(df.limit(0), ["k"], "x")).count() == 0
    assert distinct.cube(distinct.sketch(df.limit(0), ["k"], "x"), ["k"]).count() == 0


def test_joint_estimate(spark):
    a, b = spark.range(0, 30_000), spark.range(12_000, 50_000)
    both = a.withColumn("s", F.lit("a")).union(b.withColumn("s", F.lit("b")))
    config = distinct.SketchConfig(m=1024)
    s = {r["s"]: r["registers"] for r in distinct.sketch(both, ["s"], "id", config).collect()}
    pair = spark.createDataFrame([("p", s["a"], s["b"]), ("same", s["a"], s["a"])], "name STRING, registers_a BINARY, registers_b BINARY")
    got = {r["name"]: r for r in distinct.joint_counts(pair, config).collect()}
    r = got["p"]
    assert abs(r["jaccard"] - 18 / 50) < 4 * r["jaccard_error"] and r["jaccard_error"] < 0.04
    assert abs(r["n_union"] - 50_000) < 5_000 and abs(r["n_shared"] - 18_000) < 4_000
    assert got["same"]["jaccard"] > 0.99
    assert distinct.joint_counts(pair.limit(0), config).count() == 0


def test_repeated_cells(spark):
    rows = [("r", i % 9) for i in range(40)] + [("u", i) for i in range(30)] + [("few", 1)] * 19 + [("half", i % 20) for i in range(40)] + [(None, 1)] * 30 + [("nul", None)] * 30
    df = spark.createDataFrame(rows, "cell STRING, x BIGINT").withColumn("n_distinct", F.lit("clash")).withColumn("registers", F.lit(1))
    cut, errors = distinct.cut_between(0.29, 0.5, distinct.SketchConfig(m=512))
    assert 0.29 < cut < 0.5 and errors > 5 and abs((cut - 0.29) / 0.29 - (0.5 - cut) / 0.5) < 1e-9
    got = {r["cell"]: r["n_rows"] for r in distinct.repeated_cells(df, ["cell"], "x", 20, cut, distinct.SketchConfig(m=512)).collect()}
    assert got == {"r": 40}
    assert distinct.repeated_cells(df.limit(0), ["cell"], "x", 20, cut).count() == 0


def test_cube_counts_null_keys_where_they_play_no_part(spark):
    rows = [("d", "s", i) for i in range(50)] + [("d", None, i) for i in range(40, 400)] + [(None, "s", i) for i in range(30)] + [(None, None, 1), ("d", "s", None)]
    df = spark.createDataFrame(rows, "day STRING, sample STRING, x BIGINT").repartition(3)
    got = distinct.cube(distinct.sketch(df, ["day", "sample"], "x", null_keys=True), ["day", "sample"]).collect()
    assert sorted((r["day"] or "", r["sample"] or "", r["n_rows"]) for r in got) == [("", "s", 80), ("d", "", 410), ("d", "s", 50)]
    whole = {r["day"]: bytes(r["registers"]) for r in distinct.sketch(df, ["day"], "x").collect()}
    assert {r["day"]: bytes(r["registers"]) for r in got if r["sample"] is None} == whole
