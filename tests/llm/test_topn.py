import random

import pytest
from pyspark.sql import functions as F

from markerloom import session
from markerloom.llm import topn


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s):
            best[g, i] = max(s, best.get((g, i), s))
    out = set()
    for g in {k[0] for k in best}:
        ranked = sorted(((-s, i.encode()) for (h, i), s in best.items() if h == g))
        out |= {(g, i.decode(), -s, k) for k, (s, i) in enumerate(ranked[:n], 1)}
    return out


def run(df, n, fanout=64):
    return {(r["g"], r["i"], r["s"], r["rnk"]) for r in topn.top_n(df, ["g"], "i", "s", n, fanout).collect()}


@pytest.mark.parametrize("fanout", [2, 64])
def test_against_brute_force(spark, fanout):
    r = random.Random(4)
    rows = [("hot", f"i{r.randrange(900)}", r.choice([0, -1, 5, 5, 7, r.randrange(50)])) for _ in range(1500)]
    rows += [(f"g{r.randrange(40)}", r.choice(["é", "z", "Z", "a b", f"k{r.randrange(9)}"]), r.choice([None, 3, 3, r.randrange(9)])) for _ in range(400)]
    rows += [(None, "x", 1), ("n", None, 1), ("one", "x", 9), ("one", "x", 9), ("ties", "b", 1), ("ties", "a", 1), ("ties", "c", 1)]
    df = spark.createDataFrame(rows, "g STRING, i STRING, s BIGINT").withColumn("code", F.lit("clash")).withColumn("cutoff", F.lit(1)).withColumn("rnk", F.lit(1))
    for n in (1, 2, 5):
        assert run(df, n, fanout) == brute(rows, n)


def test_wide_scores_take_their_order_instead(spark):
    rows = [("g", f"i{k}", s) for k, s in enumerate([2**62, -(2**62), 0, 2**62, 2**61])]
    df = spark.createDataFrame(rows, "g STRING, i STRING, s BIGINT")
    assert run(df, 3) == brute(rows, 3)


def test_unbroadcast_cutoffs(spark, monkeypatch):
    monkeypatch.setattr(topn, "sized_broadcast", lambda df, *a: df)
    rows = [(f"g{i % 3}", f"i{i}", i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "g STRING, i STRING, s BIGINT")
    assert run(df, 4) == brute(rows, 4)


def test_crowded_groups_without_broadcast(spark, monkeypatch):
    """One group of a third of the rows is joined in salted parts, the others whole."""
    monkeypatch.setattr(topn, "sized_broadcast", lambda df, *a: df)
    r = random.Random(9)
    rows = [("hot", f"i{i}", r.randrange(300)) for i in range(1000)] + [(f"g{i % 200}", f"i{i}", r.randrange(9)) for i in range(2000)]
    assert run(spark.createDataFrame(rows, "g STRING, i STRING, s BIGINT"), 7, 8) == brute(rows, 7)


def test_rounds_read_fewer_and_fewer_rows(spark, monkeypatch):
    written = []

    def count(df, label="stage"):
        out = session.materialize(df, label)
        if label == "open-rows":
            written.append(out.count())
        return out

    monkeypatch.setattr(topn, "materialize", count)
    rows = spark.range(40_000).select((F.col("id") % 4).cast("string").alias("g"), F.format_string("i%06d", "id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(5_000))).alias("s"))
    assert topn.top_n(rows, ["g"], "i", "s", 5, 16).count() == 20
    assert len(written) > 2 and written[0] < 40_000 / 8 and written[1] < written[0] / 4 and written[2] < written[1] / 4


def test_empty(spark):
    df = spark.createDataFrame([], "g STRING, i STRING, s BIGINT")
    assert run(df, 3) == set()
    assert run(spark.createDataFrame([(None, None, None)], "g STRING, i STRING, s BIGINT"), 3) == set()
