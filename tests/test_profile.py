import math

import pytest
from pyspark.sql import functions as F

from markerloom.functions import taxonomy as tx
from markerloom.operators import features, inspect, markers, matrix, profile


@pytest.fixture(scope="module")
def db(spark):
    """Two taxa of two genomes; tag x shared, y twice in g1, the rest unique."""
    genomes = spark.createDataFrame([("g1", ["k", "A"]), ("g2", ["k", "A"]), ("g3", ["k", "B"]), ("g4", None), ("g5", ["k"])], "gcf_id STRING, taxonomy ARRAY<STRING>")
    tags = [("g1", "x"), ("g3", "x"), ("g1", "y"), ("g1", "y"), ("g2", "y"), ("g1", "a1"), ("g1", "a2"), ("g2", "a1"), ("g3", "b1"), ("g4", "b1"), ("g9", "a1"), ("g1", None), (None, "a1")]
    return spark.createDataFrame(tags, "gcf_id STRING, tag STRING"), genomes


def test_unique_markers(db):
    tags, genomes = db
    m = markers.unique_markers(markers.tag_occurrences(tags, genomes, ["kingdom", "phylum"]))
    got = {(r["level"], r["tag"], r["gcf_id"]) for r in m.collect()}
    assert {g[1:] for g in got if g[0] == "phylum"} == {("y", "g2"), ("a1", "g1"), ("a1", "g2"), ("a2", "g1"), ("b1", "g3")}
    assert ("kingdom", "x", "g1") in got  # all in one kingdom
    both = markers.unique_markers(markers.tag_occurrences(tags, genomes, ["phylum"]), drop_redundant=False)
    assert {(r["tag"], r["gcf_id"], r["n"]) for r in both.where("tag = 'y'").collect()} == {("y", "g1", 2), ("y", "g2", 1)}


def test_a_tag_that_all_genomes_have(spark):
    """One tag in 100,000 genomes of 50 species: shared at the rank of species, a marker of their kingdom in each genome."""
    genomes = spark.range(100_000).select(F.format_string("g%d", "id").alias("gcf_id"), F.array(F.lit("k"), F.format_string("p%d", F.col("id") % 50)).alias("taxonomy"))
    tags = genomes.select("gcf_id", F.lit("all").alias("tag")).union(genomes.where("gcf_id IN ('g1', 'g2')").select("gcf_id", F.concat(F.lit("own-"), "gcf_id").alias("tag")))
    m = markers.unique_markers(markers.tag_occurrences(tags, genomes, ["kingdom", "phylum"]))
    assert {(r["level"], r["tag"]): r["c"] for r in m.groupBy("level", "tag").agg(F.count(F.lit(1)).alias("c")).collect()} == {
        ("kingdom", "all"): 100_000, ("kingdom", "own-g1"): 1, ("kingdom", "own-g2"): 1, ("phylum", "own-g1"): 1, ("phylum", "own-g2"): 1}


def test_theory_counts_only_genomes_with_markers(db):
    tags, genomes = db
    m = markers.unique_markers(markers.tag_occurrences(tags, genomes, ["phylum"]))
    theory = {r["taxon"]: (r["theoretical_tag_num"], r["n_genomes"]) for r in markers.taxon_theory(m).collect()}
    assert theory == {"k\tA": (2.0, 2), "k\tB": (1.0, 1)}
    cover = markers.genome_coverage(m, genomes).first()
    assert (cover["n_genomes"], cover["percent"]) == (3, 60)


def test_abundance(spark, db):
    tags, genomes = db
    m = markers.unique_markers(markers.tag_occurrences(tags, genomes, ["phylum"]))
    reads = spark.createDataFrame([("s", t) for t in ["a1"] * 3 + ["a2", "b1", "x", "none", None]] + [(None, "a1")], "sample STRING, tag STRING")
    depth = profile.tag_depth(reads)
    a = {r["taxon"]: r for r in profile.abundance(depth, m, markers.taxon_theory(m)).collect()}
    assert (a["k\tA"]["sequenced_tag_num"], a["k\tA"]["sequenced_reads_num"], a["k\tA"]["sequenced_tag_num_gt1"]) == (2, 4, 1)
    assert math.isclose(a["k\tA"]["g_score"], math.sqrt(8)) and a["k\tA"]["percent"] == 100.0 and a["k\tA"]["relative_abundance"] == 80.0
    kept = profile.abundance(depth, m, markers.taxon_theory(m), profile.Thresholds(relative_abundance=20.0))
    assert {r["taxon"] for r in kept.collect()} == {"k\tA", "k\tB"}  # 20 reaches 20
    assert profile.abundance(depth, m, markers.taxon_theory(m), profile.Thresholds(relative_abundance=20.1)).count() == 1
    found = profile.gcf_detected(depth, m, markers.gcf_theory(m))
    assert {(r["gcf_id"], r["detected"], r["theory"]) for r in found.collect()} == {("g1", 2, 2), ("g2", 1, 2), ("g3", 1, 1)}
    chosen = profile.find_genomes(profile.abundance(depth, m, markers.taxon_theory(m)), found, 2.9, 1)  # 2.9 is cut to 2
    assert [tuple(r) for r in chosen.collect()] == [("s", "g1", "k\tA")]
    assert profile.abundance(depth.limit(0), m, markers.taxon_theory(m)).count() == 0


# Published metrics of two taxa, and what follows from them.
PUBLISHED = {"Cutibacterium_acnes": (3974, 20478, 2654.2, 7.71531912, 5.15299446, 9021.06268685, 149.72496421), "Escherichia_coli": (3071, 12401, 3101.4, 3.99851680, 4.03809834, 6171.18068120, 99.01979751)}


def test_published_metrics(spark):
    depth, theory = [], []
    for taxon, (tags, reads, expected, *_) in PUBLISHED.items():
        depth += [("s", f"{taxon}{i}", reads - tags + 1 if i == 0 else 1, taxon) for i in range(tags)]
        theory.append((taxon, expected))
    d = spark.createDataFrame(depth, "sample STRING, tag STRING, depth BIGINT, taxon STRING")
    a = profile.abundance(d.drop("taxon"), d.select("tag", "taxon"), spark.createDataFrame(theory, "taxon STRING, theoretical_tag_num DOUBLE"))
    for r in a.collect():
        *_, per_expected, per_tag, g, percent = PUBLISHED[r["taxon"]]
        assert [round(r[c], 8) for c in ("reads_per_theoretical", "reads_per_sequenced", "g_score", "percent")] == [per_expected, per_tag, g, percent]
    merged = {r["taxon"]: r["value"] for r in matrix.normalise(a, decimals=8).collect()}
    assert merged == {"Cutibacterium_acnes": 0.6586500931626503, "Escherichia_coli": 0.3413499068373496}


def test_matrix_and_functions(spark):
    long = spark.createDataFrame([("k\tA", "s1", 2.0), ("k\tB", "s1", 2.0), ("k\tA", "s2", 1.0), ("k\tC", "ctl", 3.0), ("k\tB", "ctl", 0.0), ("k\tC", "s2", 1.0), ("k\tZ", "zero", 0.0)], "taxon STRING, sample STRING, reads_per_theoretical DOUBLE")
    n = matrix.normalise(long)
    assert {(r["taxon"], r["sample"]): r["value"] for r in n.collect()}[("k\tA", "s1")] == 0.5
    wide = matrix.pivot(n, ["s2", "s1"])
    assert wide.columns == ["taxon", "s2", "s1"] and {tuple(r) for r in wide.collect()} == {("k\tA", 0.5, 0.5), ("k\tB", 0.0, 0.5), ("k\tC", 0.5, 0.0)}
    kept = matrix.without_contamination(n, " ctl , ", "zero")
    assert {(r["taxon"], r["sample"]) for r in kept.collect()} == {("k\tA", "s1"), ("k\tB", "s1"), ("k\tA", "s2")}
    table = spark.createDataFrame([("A", "1", "x"), ("B", "3", None)], "species STRING, f1 STRING, f2 STRING")
    mapping = matrix.unpivot(table, ["species"], "function", "copies")
    assert {tuple(r) for r in mapping.collect()} == {("A", "f1", 1.0), ("A", "f2", 0.0), ("B", "f1", 3.0), ("B", "f2", 0.0)}
    f = {(r["function"], r["sample"]): r["value"] for r in matrix.predict(n, mapping).collect()}
    assert f[("f1", "s1")] == 1.0 and f[("f2", "s2")] == 0.0
    m = {r["sample"]: (r["n_species"], r["n_matched"]) for r in matrix.matched_species(n, mapping).collect()}
    assert m == {"s1": (2, 2), "s2": (2, 1), "ctl": (1, 0)}


def test_features(spark):
    p = spark.createDataFrame([("s", 0, 0, 0.0), ("s", 4, 16, 8.0)], "sample STRING, sequenced_tag_num BIGINT, sequenced_reads_num BIGINT, theoretical_tag_num DOUBLE")
    r = features.classifier_features(p).collect()
    assert [r[0][n] for n in features.NAMES[:3]] == [0.0, 0.0, 0.0]
    assert math.isclose(r[1]["f_coverage"], math.log(0.5), rel_tol=1e-6) and math.isclose(r[1]["f_share"], math.log(16 / 4 * 8 / 16), rel_tol=1e-6)


def test_lineages(spark):
    rows = [("d__B;p__P;c__C;o__O;f__F;g__G;s__G x", "G1"), ("d__B;p__P;c__C;o__O;f__F;g__G", "G1"), ("B;P;C;O;F;G;S;T", "G1"), ("d__A__b; ;c__C;o__O;f__F;g__G;s__S", "G1")]
    df = spark.createDataFrame(rows, "t STRING, g STRING")
    got = [r for r in df.select(tx.parse_lineage("t", "g").alias("a"), tx.parse_lineage("t", "g", strict=True).alias("b")).collect()]
    assert got[0]["a"] == ["B", "P", "C", "O", "F", "G", "G x", "G x G1"]
    assert got[1]["a"] == ["B", "P", "C", "O", "F", "G", "G_strain", "G_strain G1"] and got[1]["b"] is None
    assert got[2]["a"] == list("BPCOFGST") and got[2]["b"] == [*"BPCOFGS", "S G1"]
    assert got[3]["a"][0] == "A__b" and got[3]["b"] is None
    paths = [("x/GCF_1.2_asm_genomic.fna.gz",), ("GCA_000.1_a_b",), ("plain",), ("a/b_genomic.fa",)]
    assert [r[0] for r in spark.createDataFrame(paths, "p STRING").select(tx.accession("p")).collect()] == ["GCF_1.2", "GCA_000.1", "plain", "b"]
    lev = spark.createDataFrame([(["a", None, "c"],), (["a"],), (None,)], "taxonomy ARRAY<STRING>").select(tx.rank_path("taxonomy", "kingdom"), tx.rank_path("taxonomy", 3), tx.rank_path("taxonomy", 3, clamp=True)).collect()
    assert [tuple(r) for r in lev] == [("a", None, None), ("a", None, "a"), (None, None, None)]
    with pytest.raises(ValueError):
        tx.level_number("domain")


def test_inspection(spark):
    ids = spark.createDataFrame([("chr:1:5",), ("chr",)], "i STRING")
    contig, pos = inspect.split_place("i")
    assert [tuple(r) for r in ids.select(contig, pos).collect()] == [("chr:1", "5"), ("chr", "0")]
    kinds = spark.createDataFrame([("a.iibsp", "x"), ("a.pos.iibdb", "x"), ("a.iibdb", "g|1"), ("a.iibdb", "chr:1")], "f STRING, i STRING")
    assert [r[0] for r in kinds.select(inspect.stream_kind("f", "i")).collect()] == ["reads", "positions", "digest", "contigs"]
    top = inspect.top_groups(spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "gcf_id STRING"), k=2)
    assert [tuple(r) for r in top.collect()] == [("c", 2), ("a", 1)]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (5 * 1024**3,)], "n BIGINT").select(inspect.human_bytes("n"))
    assert [r[0] for r in sizes.collect()] == ["0 B", "1023 B", "1.00 KB", "5.00 GB"]
    assert inspect.tag_counts(spark.createDataFrame([("t", "g"), ("t", "h")], "tag STRING, gcf_id STRING")).first().asDict() == {"n_records": 2, "n_tags": 1, "n_groups": 2}


def test_latest_listing(spark):
    rows = [("g", 1, ["a"]), ("g", 2, ["b"]), (None, 3, ["c"])]
    df = spark.createDataFrame(rows, "gcf_id STRING, at INT, ranks ARRAY<STRING>").withColumn("taxonomy", F.lit("clash"))
    assert [tuple(r) for r in markers.latest_listing(df, "gcf_id", ["at"], "ranks").collect()] == [("g", ["b"])]
