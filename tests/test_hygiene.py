import datetime as dt
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markerloom.operators import eager, orphans, rejects

LINES = "line_id BIGINT, list_file STRING, line STRING, received_at TIMESTAMP_NTZ"
OK = ["GCF_000000001.1", *[f"r{i}" for i in range(8)]]


def scan(line):
    """Character by character: the fields, or None for bad quoting."""
    fields, i = [], 0
    while True:
        j = i
        while j < len(line) and line[j] == " ":
            j += 1
        if j < len(line) and line[j] == '"':
            k, v = j + 1, ""
            while True:
                if k >= len(line):
                    return None
                if line[k] == '"':
                    if line[k + 1 : k + 2] == '"':
                        v, k = v + '"', k + 2
                        continue
                    break
                v, k = v + line[k], k + 1
            k += 1
            while k < len(line) and line[k] == " ":
                k += 1
            if k < len(line) and line[k] != "\t":
                return None
        else:
            k = line.find("\t", i)
            k = len(line) if k < 0 else k
            v = line[i:k]
            if '"' in v:
                return None
        fields.append(v.strip(" "))
        if k >= len(line):
            return fields
        i = k + 1


def expected(line):
    """ok, a reason, or None for lines that are neither."""
    if line is None:
        return None
    line = line.strip(" ")
    line = line[:-1].strip(" ") if line.endswith("\r") else line
    if not line.strip(" \t") or line.startswith("#"):
        return None
    fields = scan(line)
    if fields is None:
        return "quoting"
    if len(fields) not in (9, 10):
        return "column_count"
    bad = not re.fullmatch(r"GC[FA]_[0-9]{9}\.[0-9]+", fields[0])
    bad |= any(not f or any(unicodedata.category(c) == "Cc" and c != "\t" or c == "�" for c in f) for f in fields[1:9])
    bad |= len(fields) == 10 and fields[9] != "" and not re.search(r"\.(fa|fna|fasta)(\.gz)?\Z", fields[9])
    return "invalid_value" if bad else "ok"


def parsed(spark, lines):
    df = spark.createDataFrame([(i, "f", x, None) for i, x in enumerate(lines)], LINES).coalesce(1)
    df = df.withColumn("reason", F.lit("clash")).withColumn("ordinal", F.lit(9)).withColumn("good", F.lit(9))
    return {r["line_id"]: r for r in rejects.parse_genome_lines(df).collect()}


def test_reject_cases(spark):
    good, q = "\t".join(OK), '"'
    lines = [
        good, good + "\tx/a.fna.gz", good + "\t", f" {good}\tp.fa \r", None, "", " \t ", "# x", good.replace("r3", '"r\t3"'), good.replace("r3", '"a ""b"" c"'), good.replace("r3", 'a"b'),
        good.replace("r3", '"r3'), good.replace("r4", '"a"b'), good + '\t"a.fa', good, good.replace("r1", ""), good.replace("r1", "x\x07"), good.replace("r1", "x\x00"), good.replace("r1", "�"), good.replace("GCF", "GCX"),
        good + "\ta.txt", good + "\ta.fa\tb", "GCF_000000001.1\ta", good.replace("r3", "a\nb"), good.replace("r3", '"  "'), q, q * 2, q * 3, good.replace("r0", '"r0" ') + '\t "x.fasta"', good + "\t" + "y" * 70_000 + ".fa", good.replace("r3", 'a"') + '\tx"\t"',
        good + "\ta.fa\t", good + "\t\t", good + "\t\t\t", good + "\ta.fa\t\t", "\t".join(OK[:8]) + "\t\t\t", "\t".join(OK[:8]) + "\t\t", "\t".join(OK[:8]) + "\t", good + '\t""\t""', good + '\t"a.fa"\t',
    ]
    got = parsed(spark, lines)
    for i, line in enumerate(lines):
        want = expected(line)
        assert (got[i]["reason"] or "ok") == want if want else i not in got, (i, line)
    assert all(got[i]["reason"] == "column_count" for i in (31, 32, 33, 34, 35))
    assert got[1]["genome_path"] == "x/a.fna.gz" and got[2]["genome_path"] is None and got[8]["taxonomy"][3] == "r\t3" and got[9]["taxonomy"][3] == 'a "b" c'
    assert got[29]["genome_path"].startswith("yyy") and len(got[29]["genome_path"]) == 70_003


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='a"\t \r#', max_size=30).map(lambda s: "\t".join(OK[:8]) + s) | st.text(alphabet='a"\t ', max_size=8).map(lambda s: "\t".join(OK) + s), min_size=1, max_size=40))
def test_random_quoting(spark, lines):
    got = parsed(spark, lines)
    for i, line in enumerate(lines):
        want = expected(line)
        assert want == ((got[i]["reason"] or "ok") if i in got else None), line


def test_lines_of_the_tables(spark, sf):
    lines = spark.read.parquet(f"{sf}/raw_genome_lines.parquet")
    got = {r["line_id"]: r["reason"] or "ok" for r in rejects.parse_genome_lines(lines).collect()}
    assert got == {r["line_id"]: w for r in lines.collect() if (w := expected(r["line"]))}
    assert rejects.parse_genome_lines(lines.limit(0)).count() == 0


def test_eager_join_equals_plain_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (1, "a", None), (1, "b", 7), (2, "a", 1), (None, "a", 9), (3, "c", 4)] * 3, "k INT, g STRING, v BIGINT").withColumn("n", F.lit(1)).withColumn("v_sum", F.lit(0))
    right = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "x"), (None, "x")], "k INT, h STRING").withColumn("v", F.lit(100)).withColumn("n_l", F.lit(1))
    got = eager.eager_join_aggregate(left, right, {"k": ("k", "k")}, {"g": "g"}, {"h": "h"}, {"v": "v"}, {"w": "v"})
    plain = left.alias("l").join(right.alias("r"), F.col("l.k") == F.col("r.k")).groupBy(F.col("l.g").alias("g"), F.col("r.h").alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l.v").alias("v_sum"), F.count("l.v").alias("v_cnt"), F.sum("r.v").alias("w_sum"), F.count("r.v").alias("w_cnt"))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r) for r in plain.collect()), key=str)
    assert got.columns == plain.columns and key
    assert eager.eager_join_aggregate(left.limit(0), right, {"k": ("k", "k")}, {"g": "g"}, {"h": "h"}, {"v": "v"}).count() == 0


def test_crowded_keys(spark):
    left = spark.createDataFrame([("hot", 1)] * 6 + [(None, 2)] * 2 + [("", 3)] + [(f"t{i}", None) for i in range(11)], "t STRING, v BIGINT").withColumn("key", F.lit(1)).withColumn("share_a", F.lit(1))
    right = spark.createDataFrame([("hot",), ("t1",), ("t1",), (None,)], "t STRING")
    p = eager.crowded_key_profile(left, right, F.col("t"), F.col("t"), {"v": "v"}, 0.15, ("a", "b"))
    rows = {r["key"]: r for r in p.collect()}
    assert (rows["hot"]["n_a"], rows["hot"]["n_join"], rows["hot"]["v_join_sum"], rows["hot"]["crowded_a"]) == (6, 6, 6, True)
    assert (rows[""]["n_a"], rows[""]["n_join"], rows[""]["v_mean"], rows[""]["crowded_a"]) == (3, 0, round(7 / 3, 6), True)
    assert rows["t1"]["v_sum"] is None and rows["t1"]["n_join"] == 2 and not rows["t1"]["crowded_a"] and rows["t1"]["crowded_b"]
    found = {tuple(r) for r in eager.crowded_keys(p, {"a": "A", "b": "B"}, "taxon").collect()}
    assert found == {("A", "hot"), ("A", ""), ("B", "hot"), ("B", "t1"), ("B", "")}
    empty = eager.crowded_key_profile(left.limit(0), right.limit(0), F.col("t"), F.col("t"), {"v": "v"}, 0.1, ("a", "b"))
    assert empty.count() == 0
    one = eager.crowded_key_profile(left, right.limit(0), F.col("t"), F.col("t"), {"v": "v"}, 0.1, ("a", "b"))
    assert one.where("crowded_b").count() == 0 and one.count() == 13


T = [dt.datetime(2025, 1, 1) + dt.timedelta(days=20 * i) for i in range(12)]


def brute_status(key, at, listings):
    rows = [x for x in listings if x[0] == key]
    if not rows:
        return "missing"
    if at is None or any(s is not None and s <= at and (e is None or e > at) for _, s, e in rows):
        return None
    return "late" if all(s is None or s > at for _, s, e in rows) else "deleted"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from([None, *T]), st.sampled_from([None, *T])), max_size=14),
    st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", "c", "d", None]), st.sampled_from([None, *T])), max_size=12),
)
def test_orphans_in_time(spark, listings, refs):
    l_df = spark.createDataFrame(listings, "g STRING, s TIMESTAMP_NTZ, e TIMESTAMP_NTZ").withColumn("status", F.lit("clash")).withColumn("k", F.lit(1))
    r_df = spark.createDataFrame(refs, "id INT, g STRING, at TIMESTAMP_NTZ")
    got = {tuple(r) for r in orphans.orphans_in_time(r_df, l_df, "g", "at", "s", "e").select("id", "g", "at", "status").collect()}
    assert got == {(i, g, at, s) for i, g, at in refs if g is not None and (s := brute_status(g, at, listings))}


def test_orphan_rows_and_counts(spark):
    parents = spark.createDataFrame([("d", 1), ("d", None), (None, 2)], "db STRING, i INT").withColumn("x", F.lit(1))
    refs = spark.createDataFrame([(1, "d", 1), (2, "d", 2), (2, "d", 2), (3, None, 2), (4, "e", 1), (5, "d", None)], "id INT, db STRING, i INT").withColumn("x", F.lit(2))
    got = orphans.orphan_rows(refs, parents, ["db", "i"])
    assert sorted(r["id"] for r in got.collect()) == [2, 4] and got.columns == ["db", "i", "id", "x"]
    counts = orphans.orphan_counts(got.select(F.lit("t").alias("ref_table"), F.lit("2025-01").alias("ref_month"), F.lit("missing").alias("status")))
    assert counts.first()["n_refs"] == 2
    assert orphans.orphan_rows(refs.limit(0), parents, ["db", "i"]).count() == 0
    assert orphans.orphan_rows(refs, parents.limit(0), ["db", "i"]).count() == 3


def test_shared_folder_is_the_sessions(spark):
    from markerloom import session

    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = session.materialize(spark.range(3))
    assert df.count() == 3 and df.inputFiles()[0].startswith(session.shared_dir(spark))
    session.clean(spark)
    with pytest.raises(Exception, match="(?i)not exist|does not exist|FILE_NOT_EXIST|No such"):
        spark.read.parquet(df.inputFiles()[0]).count()
