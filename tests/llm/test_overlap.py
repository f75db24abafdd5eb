import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.llm import overlap, queries


def sets_frame(spark, sets):
    rows = [(k, s, m) for (k, s), ms in sets.items() for m in ms]
    return spark.createDataFrame(rows, "kind STRING, set STRING, member STRING")


def brute(sets, share, least):
    out = set()
    for (ka, a), ma in sets.items():
        for (kb, b), mb in sets.items():
            ma_, mb_ = set(ma), set(mb)
            if ka == kb and a < b and min(len(ma_), len(mb_)) >= least and len(ma_ & mb_) >= share * min(len(ma_), len(mb_)):
                out.add((ka, a, b))
    return out


@pytest.fixture(scope="module")
def sets():
    """Sets of very different sizes; members common to all; a small set inside a large one; equal sets."""
    common = [f"c{i}" for i in range(30)]
    sets = {("k", f"s{i:02}"): [*common, *[f"{i}-{j}" for j in range(150 + 40 * i)]] for i in range(12)}
    sets["k", "big"] = [f"big-{j}" for j in range(20_000)]
    sets["k", "inside"] = [f"big-{j}" for j in range(100, 160)] + [f"x{j}" for j in range(40)]
    sets["k", "half"] = sets["k", "s11"][:300] + [f"h{j}" for j in range(250)]
    sets["k", "twin"] = list(sets["k", "s00"])
    sets["k", "tiny"] = [f"big-{j}" for j in range(30)]
    sets["l", "big"] = [f"big-{j}" for j in range(500)]
    sets["k", "zz"] = common + [f"z{j}" for j in range(12)]  # mostly common members
    return sets


@pytest.mark.parametrize("share", [0.45, 0.3])
def test_found_pairs_equal_brute_force(spark, sets, share):
    df = sets_frame(spark, sets)
    df = df.union(df.limit(500)).withColumn("idx", F.lit(1)).withColumn("n", F.lit(1)).withColumn("small", F.lit("clash"))
    got = overlap.overlap_sizes(df, share, 39.5).collect()
    assert {(r["kind"], r["set_a"], r["set_b"]) for r in got} == brute(sets, share, 40)
    for r in got:
        a, b = (set(sets[r["kind"], r[c]]) for c in ("set_a", "set_b"))
        assert abs(r["shared"] - len(a & b)) <= 4 * r["shared_error"] + 0.5 and abs(r["n_a"] - len(a)) < 0.03 * len(a)
        assert abs(r["only_b"] - len(b - a)) < 0.03 * len(b) + 4 * r["shared_error"] + 1


def test_sample_sizes():
    assert [overlap.sample_size(x) for x in (1.0, 0.45, 0.3, 0.1, 0.01)] == [256, 256, 256, 1024, 8192]


def test_nulls_and_empty(spark):
    rows = [("k", None, "a"), ("k", "s", None), (None, "s", "a")]
    df = spark.createDataFrame(rows, "kind STRING, set STRING, member STRING")
    assert overlap.overlap_sizes(df, 0.3).count() == 0
    with pytest.raises(ValueError):
        overlap.overlap_sizes(df, 0.0)


def test_joint_estimate_of_full_registers():
    """Few registers and many members: the estimate rests on register values, not on members."""
    p, m, rng = 10, 1024, np.random.default_rng(5)

    def registers(h):
        idx, rest = (h >> np.uint64(54)).astype(int), (h << np.uint64(10)).astype(np.uint64)
        rho = 64 - np.floor(np.log2(np.maximum(rest.astype(float), 1))).astype(int)
        out = np.zeros(m, dtype=int)
        np.maximum.at(out, idx, rho)
        return out

    both, only_a, only_b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (60_000, 40_000, 90_000))
    ra, rb = registers(np.r_[both, only_a]), registers(np.r_[both, only_b])
    pairs, cnt = np.unique(np.stack([ra, rb], axis=1), axis=0, return_counts=True)
    a, b, x, error = overlap.joint_estimate(pairs[:, 0], pairs[:, 1], cnt, p)
    assert abs(x - 60_000) < 9_000 and abs(a - 40_000) < 9_000 and abs(b - 90_000) < 9_000 and 1_000 < error < 5_000 and abs(x - 60_000) < 4 * error
    # With a sample's matches beside the registers the estimate is nearer and its error smaller.
    *_, x2, error2 = overlap.joint_estimate(pairs[:, 0], pairs[:, 1], cnt, p, 307, 512)
    assert error2 < error and abs(x2 - 60_000) < 4 * error2


def test_sizes_and_bytes(spark):
    df = spark.range(50_000).select(F.when(F.col("id") < 100, "few").otherwise("many").alias("set"), F.lit("k").alias("kind"), F.col("id").alias("member"))
    for p, tolerance in ((14, 0.03), (10, 0.12)):
        got = {r["set"]: r for r in overlap.sketch_sets(overlap.hashed_members(df.union(df).repartition(5)), p).collect()}
        assert got["few"]["n"] == 100 and got["few"]["whole"] and len(got["few"]["registers"]) <= 400
        assert abs(got["many"]["n"] - 49_900) < tolerance * 49_900 and not got["many"]["whole"]
        assert len(got["many"]["registers"]) == 2**p and len(got["many"]["sample"]) == overlap.SAMPLE


def test_partial_sketches_merge_to_the_whole(spark):
    df = spark.range(20_000).select(F.lit("k").alias("kind"), (F.col("id") % 7).alias("set"), (F.col("id") % 9_000).alias("member"))
    hashed = overlap.hashed_members(df)
    one = {r["set"]: (bytes(r["registers"]), r["sample"]) for r in overlap.sketch_sets(hashed.coalesce(1), 8, 64).collect()}
    many = {r["set"]: (bytes(r["registers"]), r["sample"]) for r in overlap.sketch_sets(hashed.repartition(40), 8, 64).collect()}
    assert one == many and len(one) == 7


def test_query(spark, sf):
    assert set(queries.p1_found(spark, sf).columns) == {"kind", "set_a", "set_b"}


def exact(sets):
    own = {k: set(v) for k, v in sets.items()}
    return {(ka, a, b): (len(ma), len(mb), len(ma & mb)) for (ka, a), ma in own.items() for (kb, b), mb in own.items() if ka == kb and a < b and ma & mb}


def test_shared_counts_equal_brute_force(spark, sets):
    df = sets_frame(spark, sets)
    nulls = spark.createDataFrame([("k", None, "c1"), ("k", "s00", None), (None, "s00", "c1")], df.schema)
    got = overlap.shared_counts(df.union(df.limit(500)).union(nulls).withColumn("n", F.lit(1)).withColumn("sets", F.lit("clash"))).collect()
    assert {(r["kind"], r["set_a"], r["set_b"]): (r["n_a"], r["n_b"], r["shared"]) for r in got} == exact(sets) and len(got) == len(exact(sets))
    assert all(r["only_a"] == r["n_a"] - r["shared"] and r["only_b"] == r["n_b"] - r["shared"] and r["share"] == r["shared"] / min(r["n_a"], r["n_b"]) for r in got)
    assert overlap.shared_counts(df.limit(0)).count() == 0


def test_overlap_sizes_query_has_every_pair(spark, sf):
    sets = {}
    for r in queries._members(spark, sf).dropna().distinct().collect():
        sets.setdefault((r["kind"], r["set"]), []).append(r["member"])
    got = queries.p1_overlap_sizes(spark, sf).collect()
    assert {(r["kind"], r["set_a"], r["set_b"]): (r["n_a"], r["n_b"], r["shared"]) for r in got} == exact(sets)
    assert min(r["share"] for r in got) < 0.1 and min(min(r["n_a"], r["n_b"]) for r in got) < 40


def inside(rng, name, small, share, large):
    """A set of ``small`` members of which ``share`` are the large set's."""
    return [int(x) for x in rng.choice(large, int(small * share), replace=False)] + [int(x) for x in rng.integers(1 << 40, 1 << 62, small - int(small * share))]


@pytest.mark.parametrize(("small", "large"), [(500, 50_000), (5_000, 200_000)])
def test_small_sets_in_huge_ones(spark, small, large):
    """Registers hide nearly all of a small set in a set of 50 to 200 members for each register (p = 10); the samples do not."""
    rng = np.random.default_rng(3)
    sets = {("k", "huge"): list(range(large))}
    for i in range(12):
        sets["k", f"in{i:02}"] = inside(rng, i, small, (0.45, 0.6, 1.0)[i % 3], large)
        sets["k", f"out{i:02}"] = inside(rng, i, small, 0.15, large)
    df = spark.createDataFrame([(k, s, m) for (k, s), ms in sets.items() for m in ms], "kind STRING, set STRING, member BIGINT")
    got = {(r["set_a"], r["set_b"]): r for r in overlap.overlap_sizes(df, 0.3, 40, 10).collect()}
    assert {k for k in got} == {("huge", f"in{i:02}") for i in range(12)}
    for (_, b), r in got.items():
        true = len(set(sets["k", b]) & set(sets["k", "huge"]))
        assert abs(r["shared"] - true) <= 4 * r["shared_error"] + 0.01 * true


def test_recall_and_errors_over_many_pairs(spark):
    """120 pairs down to the share asked for: every one is found, and the stated error holds."""
    rng = np.random.default_rng(4)
    rows, true = [], {}
    for i in range(120):
        n, share = int(rng.choice([45, 150, 400, 900])), float(rng.uniform(0.32, 0.95))
        other = rng.integers(0, 1 << 40, int(n * rng.uniform(1.1, 8)))
        mine = np.r_[other[: int(np.ceil(n * share))], rng.integers(1 << 41, 1 << 60, n - int(np.ceil(n * share)))]
        rows += [("k", f"a{i:03}", int(x)) for x in mine] + [("k", f"b{i:03}", int(x)) for x in other]
        true[f"a{i:03}", f"b{i:03}"] = len(set(mine.tolist()) & set(other.tolist()))
    got = {(r["set_a"], r["set_b"]): r for r in overlap.overlap_sizes(spark.createDataFrame(rows, "kind STRING, set STRING, member BIGINT"), 0.3, 40, 12).collect()}
    assert set(got) == set(true)
    off = [(r["shared"] - true[k]) / r["shared_error"] for k, r in got.items() if r["shared_error"] > 0]
    assert len(off) > 30 and max(map(abs, off)) < 4.5 and 0.2 < float(np.std(off)) < 1.5
    assert all(r["shared"] == true[k] for k, r in got.items() if r["shared_error"] == 0)
