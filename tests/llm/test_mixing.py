from collections import Counter

import pytest
from pyspark.sql import functions as F

from markerloom.llm import mixing


@pytest.fixture(scope="module")
def counted(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "mid", 20) for i in range(300)] + [(20_000 + i, "small", 5) for i in range(40)] + [(30_000 + i, None, 50) for i in range(20)] + [(40_000, "mid", 0), (40_001, "other", 9), (40_002, "big", None)]
    return spark.createDataFrame(rows, "doc_id BIGINT, source STRING, tokens BIGINT").withColumn("key", F.lit("clash")).withColumn("rest", F.lit(1)).withColumn("range", F.lit(1))


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 0.5, 3), ("mid", 0.4, 5), ("small", 0.05, 4), ("none", 0.05, 9)], "source STRING, target_share DOUBLE, max_repeats INT").withColumn("tokens", F.lit("clash"))


def test_budgets_and_repeats(spark, counted, targets, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 100)
    rows = counted.collect()
    total = sum(r["tokens"] or 0 for r in rows)
    mixed = mixing.mix(counted, targets).collect()
    got = Counter()
    for r in mixed:
        got[r["source"]] += r["tokens"]
    assert abs(got["big"] - 0.5 * total) <= 8.5 and abs(got["mid"] - 0.4 * total) <= 10.5
    assert got["small"] == 40 * 5 * 4 and set(got) == {"big", "mid", "small"}
    per = Counter((r["source"], r["doc_id"]) for r in mixed)
    mid = 300 * 20
    assert {c for (s, _), c in per.items() if s == "small"} == {4}
    whole = int(0.4 * total // mid)
    assert {c for (s, d), c in per.items() if s == "mid" and d != 40_000} == {whole, whole + 1}
    assert len({(r["doc_id"], r["epoch"]) for r in mixed}) == len(mixed)
    report = {r["source"]: r for r in mixing.mix_report(counted, targets).collect()}
    assert {s for s, r in report.items() if r["short"]} == {"small", "none"}
    assert report["small"]["mix_tokens"] == 800 and report["none"]["mix_tokens"] == 0 and report["none"]["reached_share"] == 0.0
    assert abs(report["big"]["reached_share"] - 0.5) < 0.001 and abs(sum(r["mix_share"] for r in report.values()) - 1) < 1e-9


def test_the_mix_does_not_depend_on_partitions(spark, counted, targets):
    a = sorted(map(tuple, mixing.mix(counted, targets).collect()))
    b = sorted(map(tuple, mixing.mix(counted.repartition(7), targets).collect()))
    assert a == b
    c = sorted(map(tuple, mixing.mix(counted, targets, seed=5).collect()))
    assert a != c


def test_empty(spark, counted, targets):
    assert mixing.mix(counted.limit(0), targets).count() == 0
    report = mixing.mix_report(counted.limit(0), targets).collect()
    assert len(report) == 4 and not any(r["short"] for r in report)
    assert mixing.mix(counted, targets.limit(0)).count() == 0 and mixing.mix_report(counted, targets.limit(0)).count() == 0


def test_measure_counts_null_and_long_texts(spark):
    df = spark.createDataFrame([(1, "s", None), (2, "s", ""), (3, None, "word " * 30_000), (4, "s", "x")], "doc_id BIGINT, source STRING, text STRING").withColumn("measured_text", F.lit("clash"))
    got = {r["doc_id"]: r["tokens"] for r in mixing.measure(df).collect()}
    assert got[1] == got[2] == 0 and got[3] > 29_000 and got[4] == 1
