import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markerloom.enzymes import ENZYMES, enzyme
from markerloom.functions import dna
from markerloom.operators import digest

COMPLEMENT = str.maketrans("ACGTacgt", "TGCATGCA")


def brute_windows(seq, e):
    """Every window by itself against both strands."""
    n, out = e.tag_length, []
    for i in range(len(seq) - n + 1):
        w = seq[i : i + n]
        if re.fullmatch(e.forward, w) or re.fullmatch(e.reverse, w):
            out.append((i, w))
    return out


def planted(e, rng, length=400):
    """Random bases with some N and some sites of either strand written in."""
    seq = list(rng.choice(list("ACGTN"), length, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    for k, pattern in enumerate((e.forward, e.reverse) * 3):
        site = "".join(rng.choice(list(t[1:-1])) if t.startswith("[") else t for t in re.findall(r"\[[ACGT]+\](?!\{)|[ACGT]", re.sub(r"(\[[ACGT]+\]|[ACGT])\{(\d+)\}", lambda m: m[1] * int(m[2]), pattern)))
        at = 11 + k * 60
        seq[at : at + len(site)] = site
    return "".join(seq)


def test_catalog_shapes():
    assert [e.tag_length for e in ENZYMES] == [33, 27, 27, 28, 32, 28, 27, 27, 27, 27, 27, 27, 27, 27, 32, 25]
    assert enzyme("bcgi") is enzyme("5") is enzyme(5)
    assert {e.name for e in ENZYMES if e.forward == e.reverse} == {"BplI", "FalI", "AlfI"}
    with pytest.raises(ValueError):
        enzyme("EcoRI")


def test_every_enzyme_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(e.name, planted(e, rng)) for e in ENZYMES]
    for (name, seq), e in zip(rows, ENZYMES, strict=True):
        df = spark.createDataFrame([(name, seq)], "name STRING, seq STRING")
        got = df.select(dna.all_windows("seq", e).alias("a"), dna.windows_of_both("seq", e).alias("b")).first()
        want = brute_windows(seq, e)
        assert len(want) >= 6
        assert got["a"] == [w for _, w in want]
        assert sorted(got["b"]) == sorted(w for _, w in want)
        at = digest.digest_positions(df, ["name"], e, size=64).orderBy("pos").collect()
        assert [r["pos"] for r in at] == [i for i, _ in want]


def test_chunks_of_long_sequences_give_each_site_once(spark):
    """All enzymes in one pass over chunks of 64 letters: windows of different lengths at every border."""
    rng = np.random.default_rng(8)
    seq = "".join(planted(e, rng) for e in ENZYMES) + "é" + planted(ENZYMES[4], rng)
    df = spark.createDataFrame([("long", seq), ("short", seq[:50]), ("none", None)], "name STRING, seq STRING")
    names = [e.name for e in ENZYMES]
    count = lambda rows: sorted((r["name"], r["enzyme"], r["tag"]) for r in rows)
    whole = count(digest.digest(df, ["name"], names).collect())
    assert len(whole) > 96 and count(digest.digest(df, ["name"], names, size=64).collect()) == whole
    assert sum(n == "long" and e == "BcgI" for n, e, _ in whole) == len(brute_windows(seq.upper(), ENZYMES[4]))


def test_sites_are_numbered_through_a_genome(spark):
    sites = spark.createDataFrame([("g", 1, 9), ("g", 1, 3), ("g", 4, 1), ("h", 2, 5), ("g", 2, 0), (None, 1, 1), ("g", None, 1)], "gcf_id STRING, ordinal INT, pos INT").withColumn("n", F.lit(1))
    got = {(r["gcf_id"], r["ordinal"], r["pos"]): r["tag_index"] for r in digest.numbered_sites(sites).collect()}
    assert got == {("g", 1, 3): 1, ("g", 1, 9): 2, ("g", 2, 0): 3, ("g", 4, 1): 4, ("h", 2, 5): 1}


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ACGTNacgt", max_size=90))
def test_canonical_of_either_strand_is_equal(spark_text):
    other = spark_text.upper().translate(COMPLEMENT)[::-1]
    assert min(spark_text.upper(), other) == min(other, other.translate(COMPLEMENT)[::-1])


def test_digest_edges(spark):
    site = "A" * 10 + "CGA" + "T" * 6 + "TGC" + "C" * 10
    rows = [(1, None), (2, ""), (3, "ACGT"), (4, site.lower()), (5, site[:20] + "N" + site[21:]), (6, site + site)]
    df = spark.createDataFrame(rows, "id INT, seq STRING").withColumn("tag", F.lit("clash")).withColumn("enzyme", F.lit("clash"))
    got = sorted((r["id"], r["tag"]) for r in digest.digest(df.select("id", "seq", "tag", "enzyme"), ["id"], ["BcgI"]).collect())
    tag = min(site, site.translate(COMPLEMENT)[::-1])
    assert [g for g in got if g[0] == 4] == [(4, tag)]
    assert not [g for g in got if g[0] in (1, 2, 3, 5)]
    assert len([g for g in got if g[0] == 6]) == len(brute_windows(site + site, enzyme("BcgI")))


def test_first_tag_prefers_forward(spark):
    e = enzyme("BslFI")
    reverse, forward = "A" * 14 + "GTCCC" + "A" * 6, "T" * 6 + "GGGAC" + "T" * 14
    df = spark.createDataFrame([(1, reverse + forward), (2, reverse), (3, "A" * 51 + forward)], "id INT, seq STRING")
    got = {r["id"]: r["tag"] for r in digest.first_tags(df, ["id"], e).collect()}
    canonical = lambda w: min(w, w.translate(COMPLEMENT)[::-1])
    assert got == {1: canonical(forward), 2: canonical(reverse)}


def test_read_tag_ids_count_by_offset(spark):
    site = "A" * 10 + "GCA" + "C" * 6 + "TGC" + "T" * 10
    got = digest.read_tags(spark.createDataFrame([("r1 extra", "AC" + site + "GG" + site)], "id STRING, seq STRING"), [], "id", "AlfI")
    assert sorted(r["tag_id"] for r in got.collect()) == ["r1_tag1", "r1_tag2"]


# Canonical tags and their hashes.
VECTORS = {
    "GAAGGCTGGTGCACCGTCGTCGGACACAAATC": 5555759523427700925,
    "CTGGCCCGTCGCACCGACTTCGAGGTAACGGC": 18247213086513812779,
    "CTCGTTGAGCCGATCTCGATGCGTGACCCGTC": 8927941556630361387,
    "GCGGTACTTCCGATCGTCCTGCGCCAATCAGC": 11255199311847124992,
}


def test_tag_hash(spark):
    df = spark.createDataFrame([*[(t,) for t in VECTORS], (None,), ("A" * 27,), ("A" * 25,)], "tag STRING")
    got = {r["tag"]: r for r in df.select("tag", dna.tag_hash("tag").alias("h")).select("tag", "h", dna.unsigned("h").alias("u"), dna.hash_hex("h").alias("x")).collect()}
    assert {t: int(got[t]["u"]) for t in VECTORS} == VECTORS
    assert got["CTGGCCCGTCGCACCGACTTCGAGGTAACGGC"]["h"] == -199530987195738837
    assert got["CTGGCCCGTCGCACCGACTTCGAGGTAACGGC"]["x"] == f"{18247213086513812779:016x}"
    assert got[None]["h"] is None

    def plain(tag):
        h, raw = 0, tag.encode()
        while raw:
            n = 8 if len(raw) >= 8 else 4 if len(raw) >= 4 else 1
            h = ((((h << 5) | (h >> 59)) & (2**64 - 1)) ^ int.from_bytes(raw[:n], "little")) * 0x517CC1B727220A95 % 2**64
            raw = raw[n:]
        return h

    for t in ("A" * 27, "A" * 25):
        assert got[t]["h"] % 2**64 == plain(t)


def test_read_filters(spark):
    q = dna.ReadQuality()
    rows = [("ACGTN" * 5, None), ("A" * 23 + "NN", "I" * 25), ("A" * 24 + "nn", "I" * 20 + "!" * 6), ("", ""), (None, None), ("A" * 100, "?" * 80 + "!" * 20), ("A" * 100, "?" * 79 + "!" * 21)]
    df = spark.createDataFrame(rows, "seq STRING, qual STRING")
    got = df.select(q.few_n("seq").alias("n"), q.good_quality("qual").alias("q"), dna.ReadQuality(max_n=1).few_n("seq").alias("abs"), dna.ReadQuality(enabled=False).good_quality("qual").alias("off")).collect()
    assert [r["n"] for r in got] == [False, True, True, False, False, True, True]
    assert [r["q"] for r in got] == [True, True, False, True, True, True, False]
    assert [r["abs"] for r in got] == [False, False, True, True, None, True, True]
    assert all(r["off"] for r in got)


def test_digest_stats(spark):
    site = "A" * 10 + "CGA" + "T" * 6 + "TGC" + "C" * 10
    df = spark.createDataFrame([("a", site), ("a", "ACGT"), ("a", None), ("b", "N" * 40)], "sample STRING, seq STRING")
    got = {r["sample"]: (r["input_sequences"], r["tag_count"], r["percent"]) for r in digest.digest_stats(df, "sample", "BcgI").collect()}
    assert got == {"a": (3, 1, "33.33%"), "b": (1, 0, "0.00%")}
