import gzip
import json
import lzma
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from markerloom.functions.dna import ReadQuality
from markerloom.operators import digest, features, matrix, profile
from markerloom.plans import pipeline
from markerloom.sources import collections, fastx, files, sample_files, tables, tagdb, tagstream
from markerloom.streaming import tag_counts


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    fastx.register(spark)


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first contig\nACGT\r\nAC\n\n>\nGG\n>empty\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\nIIII\n@r2\nNN\n+r2\n!!\n")
    (tmp_path / "c.fastq.zst").write_bytes(zstandard.compress(b"@r3\nA\n+\nI\n"))
    (tmp_path / "ignored.txt").write_text("no")
    df = spark.read.format("fastx").option("path", str(tmp_path)).load()
    got = {(r["header"], r["seq"], r["qual"], r["ordinal"]) for r in df.collect()}
    assert got == {("c1 first contig", "ACGTAC", None, 1), ("", "GG", None, 2), ("empty", "", None, 3), ("r1 x", "ACGT", "IIII", 1), ("r2", "NN", "!!", 2), ("r3", "A", "I", 1)}
    assert df.rdd.getNumPartitions() == 3
    (tmp_path / "bad.fq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        spark.read.format("fastx").option("path", str(tmp_path / "bad.fq")).load().count()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("fastx").option("path", str(tmp_path / "nowhere.fa")).load().count()


@pytest.mark.parametrize("compression", ["zstd", "gzip", "none"])
def test_tagstream_round_trip(spark, tmp_path, compression):
    rows = [(-5, "r1_tag1"), (2**62, "é|1:2"), (0, ""), (7, "x" * 300)]
    df = spark.createDataFrame(rows, "hash BIGINT, id STRING").repartition(2)
    df.write.format("tagstream").option("path", str(tmp_path / "out")).option("compression", compression).mode("append").save()
    back = spark.read.format("tagstream").option("path", str(tmp_path / "out")).load()
    assert sorted((r["hash"], r["id"]) for r in back.collect()) == sorted(rows)


def test_tagstream_ends(tmp_path):
    whole = tagstream.pack(1, "ab")
    for cut, want in ((whole + b"\1\2\3", [(1, "ab")]), (whole, [(1, "ab")]), (b"", [])):
        path = tmp_path / "s.iibsp"
        path.write_bytes(cut)
        with files.open_input(str(path)) as f:
            assert list(tagstream.parse(f)) == want
    path.write_bytes(whole[:-1])
    with files.open_input(str(path)) as f, pytest.raises(ValueError, match="inside an id"):
        list(tagstream.parse(f))
    assert len(tagstream.pack(1, "a" * 70_000)) == 10 + 65_535


def test_tagdb_round_trip_and_versions(spark, tmp_path):
    rows = [(-9, "g1"), (5, "g2"), (-9, "g2"), (11, "g1")]
    spark.createDataFrame(rows, "hash BIGINT, gcf_id STRING").coalesce(1).write.format("tagdb").option("path", str(tmp_path / "BcgI.species.iibdb")).mode("append").save()
    back = spark.read.format("tagdb").option("path", str(tmp_path / "BcgI.species.iibdb")).load()
    assert sorted((r["hash"], r["gcf_id"]) for r in back.collect()) == sorted(rows)
    assert [p.name for p in tmp_path.iterdir()] == ["BcgI.species.iibdb"]
    with files.open_input(str(tmp_path / "BcgI.species.iibdb")) as f:
        assert tagdb.read_header(f)[:2] == (3, 4)
    assert tagdb.is_compact(str(tmp_path / "BcgI.species.iibdb"))
    records = struct.pack("<qIqI", 3, 1, 4, 9)
    for version, body in ((1, records), (2, zstandard.compress(records))):
        p = tmp_path / f"v{version}.iibdb"
        p.write_bytes(b"IIBC" + struct.pack("<II", version, 2) + b"\2\0g1\2\0g2" + body)
        got = spark.read.format("tagdb").option("path", str(p)).load().orderBy("hash").collect()
        assert [(r["hash"], r["gcf_index"], r["gcf_id"]) for r in got] == [(3, 1, "g2"), (4, 9, None)]
    for raw, why in ((b"XXXX1234", "not a compact"), (b"IIBC" + struct.pack("<I", 7), "unknown version"), (b"IIBC\1", "inside its header")):
        (tmp_path / "bad.iibdb").write_bytes(raw)
        with files.open_input(str(tmp_path / "bad.iibdb")) as f, pytest.raises(ValueError, match=why):
            tagdb.read_header(f)
    (tmp_path / "tiny").write_bytes(b"II")
    assert not tagdb.is_compact(str(tmp_path / "tiny"))


def test_lists(spark, tmp_path):
    def at(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    got = tables.sample_list(spark, at("s", "# x\n\ns1\ta.fq\ts1_2.fq\n s2\tb.fq\nonly\n")).orderBy("sample").collect()
    assert [tuple(r) for r in got] == [("s1", "a.fq", "s1_2.fq"), ("s2", "b.fq", None)]
    assert tables.sample_names(spark, at("n", "s1\tx\ns2")).count() == 2
    plain = tables.genome_list(spark, at("g", "G1\t" + "\t".join("abcdefgh") + "\tp.fa\nG2\ta\n")).collect()
    assert [tuple(r) for r in plain] == [("G1", list("abcdefgh"), "p.fa")]
    lineage = tables.genome_list(spark, at("h", "accession\tgtdb_taxonomy\nGCF_1.1_x\td__A;p__B;c__C;o__D;f__E;g__F;s__G\tq.fa\n")).collect()
    assert [tuple(r) for r in lineage] == [("GCF_1.1", [*"ABCDEFG", "G GCF_1.1"], "q.fa")]
    assert tables.genome_list(spark, at("e", "\n# nothing\n")).count() == 0
    assert [tuple(r) for r in tables.rank_list(spark, at("r", "G1\ta \t b\nG2\n")).collect()] == [("G1", ["a", "b"])]
    p = tables.profile_table(spark, at("x.xls", "#Kingdom\tSpecies\t...\nK\tS\t2654.2\t3974\t149.72%\t20478\t7.7\t5.1\t3735\tbad\n")).first()
    assert (p["taxon"], p["theoretical_tag_num"], p["percent"], p["g_score"]) == ("K\tS", 2654.2, 149.72, 0.0)
    enzymes, rows = tables.combined_profile(spark, at("c", "#BcgI AlfI combine\n#Kingdom\nK\tS\t1\t2\t3\t4\t5\t6\t7\t8.5\n"))
    assert enzymes == ["AlfI", "BcgI"] and rows.first()["g_score"] == 8.5
    d = tables.detected_table(spark, at("d", "K\tS\tG1\t2578\t2533\t0.9825\nK\tS\tG2\tx\ty\t0\n")).orderBy("gcf_id").collect()
    assert [(r["gcf_id"], r["theory"], r["detected"]) for r in d] == [("G1", 2578, 2533), ("G2", 0, 0)]
    m = tables.mapping_matrix(spark, at("m", "#Species\tK1\tK2\nA\t1\tx\nA\t2\t3\n"))
    assert {tuple(r) for r in m.collect()} == {("A", "K1", 2.0), ("A", "K2", 3.0)}
    w = tables.merged_matrix(spark, at("w", "Kingdom\tSpecies\ts1\ts2\nK\tA\t0.5\t\nK\tB\t0.25\t1\n"))
    assert {tuple(r) for r in w.collect()} == {("K\tA", "s1", 0.5), ("K\tA", "s2", 0.0), ("K\tB", "s1", 0.25), ("K\tB", "s2", 1.0)}


def test_text_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (0.0,), (1e-5,), (0.6586500931626503,), (1e22,), (None,)], "x DOUBLE")
    assert [r[0] for r in df.select(tables.shortest_decimal("x")).collect()] == ["1", "0", "0.00001", "0.6586500931626503", "10000000000000000000000", None]
    tables.write_table(df, str(tmp_path / "t"))
    genomes = spark.createDataFrame([("G2", ["a", "b"]), ("G1", ["a", "c"]), ("G1", ["a", "c"])], "gcf_id STRING, taxonomy ARRAY<STRING>")
    tables.write_classification(genomes, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 3
    assert [r[0] for r in tables.classification_lines(genomes).collect()] == ["G1\ta\tc", "G2\ta\tb"]


SITE = "{}CGAAAAAAATGC{}"


def _tag(i):
    """A BcgI site with its own flanks."""
    digits = "".join("ACGT"[(i >> (2 * k)) & 3] for k in range(10))
    return SITE.format(digits, digits[::-1])


@pytest.fixture(scope="module")
def study(spark):
    genomes = spark.createDataFrame([(f"g{i}", ["k", "p", "c", "o", "f", "g", f"sp{i // 2}", f"st{i}"]) for i in range(4)] + [("g9", ["k"] * 8)], "gcf_id STRING, taxonomy ARRAY<STRING>")
    contigs = spark.createDataFrame([(f"g{i}", "N".join(_tag(100 * (i // 2) + j) for j in range(30)) + "N" + _tag(999)) for i in range(4)], "gcf_id STRING, seq STRING")
    reads = [("s1", _tag(j), "I" * 32) for j in range(20)] + [("s1", _tag(100), "I" * 32)] * 3 + [("s2", _tag(100 + j), None) for j in range(25)] + [("s2", _tag(5), "!" * 32), ("ctl", _tag(3), None)]
    return contigs, genomes, spark.createDataFrame(reads, "sample STRING, seq STRING, qual STRING")


def test_pipeline(spark, study, tmp_path):
    contigs, genomes, reads = study
    settings = pipeline.Settings(controls="ctl", as_text=True, g_score=2.0, min_tags=0)
    with pytest.raises(ValueError, match="sample-only"):
        pipeline.run(contigs, genomes, reads, settings, str(tmp_path), mode="sample-only")
    db = pipeline.run(contigs, genomes, reads, settings, str(tmp_path), mode="db-only")
    assert db["markers"].select("tag").distinct().count() == 60  # the tag of both species is no marker
    made = sorted(p.name for p in tmp_path.iterdir())
    out = pipeline.run(contigs, genomes, reads, settings, str(tmp_path), mode="sample-only")
    assert set(made) <= {p.name for p in tmp_path.iterdir()}
    rough = {(r["sample"], r["taxon"].split("\t")[-1]): r["sequenced_reads_num"] for r in out["qualitative"].collect()}
    assert rough == {("s1", "sp0"): 20, ("s1", "sp1"): 3, ("s2", "sp1"): 25, ("ctl", "sp0"): 1}  # the read of bad quality is gone
    assert {(r["sample"], r["gcf_id"]) for r in out["selected"].collect()} == {("s1", "g0"), ("s1", "g1"), ("s2", "g2"), ("s2", "g3")}
    fine = {(r["sample"], r["taxon"].split("\t")[-1]): r["theoretical_tag_num"] for r in out["quantitative"].collect()}
    assert fine == {("s1", "sp0"): 31.0, ("s2", "sp1"): 31.0}  # each sample's own genomes: the shared tag is a marker now
    assert {r["sample"] for r in out["filtered"].collect()} == {"s1", "s2"}
    free = pipeline.run(contigs, genomes, reads, settings, mapping=matrix.unpivot(spark.createDataFrame([("sp0", "2")], "species STRING, f STRING"), ["species"], "function", "copies"))
    assert {tuple(r) for r in free["functions"].collect()} == {("f", "s1", 1.0)}
    assert [r["gcf_id"] for r in pipeline.unread_genomes(contigs, genomes).collect()] == ["g9"]
    with pytest.raises(ValueError, match="no genome gives a tag"):
        pipeline.run(contigs.limit(0), genomes, reads, settings)
    assert ReadQuality() == pipeline.Settings().quality and json.dumps(settings, default=str)


def test_streamed_depth_equals_batch(spark, sf, tmp_path):
    tags = spark.read.parquet(f"{sf}/write_tasks.parquet")
    for i in range(3):
        tags.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}

    def sink(batch, _):
        got.update({(r["sample"], r["enzyme"], r["hash"]): r["depth"] for r in batch.collect()})

    stream = tag_counts.arriving_tags(spark, str(tmp_path / "in"), tags.schema, max_files=1)
    tag_counts.write_running(tag_counts.running_depth(stream), sink, str(tmp_path / "cp")).awaitTermination(120)
    want = profile.tag_depth(tags.withColumnRenamed("hash", "tag"), ["sample", "enzyme"])
    assert got == {(r["sample"], r["enzyme"], r["tag"]): r["depth"] for r in want.collect()}
    windows = tag_counts.windowed_depth(tag_counts.arriving_tags(spark, str(tmp_path / "in"), tags.schema))
    q = windows.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").count() > 0


def test_made_digests_and_descriptions(spark, tmp_path):
    def put(name, *records):
        (tmp_path / name).write_bytes(b"".join(tagstream.pack(*r) for r in records))

    put("GCF_1.1.BcgI.iibdb", (1, "chr:1:5"), (2, "chr"))
    put("GCF_1.1.BcgI.iibsp", (9, "x:1"))
    put("GCF_2.1.BcgI.iibsp", (3, "GCF_7.1|0|c2|8|0|0"))
    (tmp_path / "GCF_3.1.BcgI.iibdb").write_bytes(tagstream.pack(4, "abc")[:-1])
    genomes = spark.createDataFrame([("GCF_1.1",), ("GCF_2.1",), ("GCF_3.1",), ("GCF_4.1",), (None,)], "gcf_id STRING")
    got = collections.made_digests(spark, genomes, str(tmp_path), "BcgI")
    assert {tuple(r) for r in got.collect()} == {("GCF_1.1", "chr:1", 5, 1), ("GCF_1.1", "chr", 0, 2), ("GCF_2.1", "GCF_7.1|0|c2|8|0|0", 0, 3)}
    own = collections.made_digests(spark, genomes, str(tmp_path), "BcgI", for_samples=True)
    assert ("GCF_7.1", "c2", 8, 3) in {tuple(r) for r in own.collect()}
    assert [r["gcf_id"] for r in collections.digest_files(spark, genomes, str(tmp_path), "BcgI").where("path IS NULL").collect()] == ["GCF_4.1"]
    (tmp_path / "AlfI.genus.iibdb").write_bytes(b"IIBC" + struct.pack("<IQI", 3, 1, 1) + b"\1\0g" + zstandard.compress(struct.pack("<qI", 6, 0)))
    rows, broken = collections.describe_files(spark, str(tmp_path))
    by = {r["file"].rsplit("/", 1)[-1]: r for r in rows.collect()}
    assert (by["AlfI.genus.iibdb"]["enzyme"], by["AlfI.genus.iibdb"]["level"], by["AlfI.genus.iibdb"]["kind"], by["AlfI.genus.iibdb"]["records"]) == ("AlfI", "genus", "database", 1)
    assert by["GCF_1.1.BcgI.iibsp"]["kind"] == "reads" and by["GCF_1.1.BcgI.iibdb"]["kind"] == "contigs"
    assert [r["file"].rsplit("/", 1)[-1] for r in broken.collect()] == ["GCF_3.1.BcgI.iibdb"]
    counted = collections.count_records(spark, f"{tmp_path}/AlfI.genus.iibdb,{tmp_path}/GCF_1.1.BcgI.iibdb", distinct=True)
    assert {(r["file"].rsplit("/", 1)[-1], r["n_records"], r["n_tags"]) for r in counted.collect()} == {("AlfI.genus.iibdb", 1, 1), ("GCF_1.1.BcgI.iibdb", 2, 2)}


def _field(number, value):
    """A protocol-buffer field: a whole number, or bytes of a text or message."""
    def varint(n):
        out = b""
        while True:
            out += bytes([(n & 127) | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def test_onnx_scoring(spark):
    """A model whose label is the place of the largest feature, written by hand."""
    dims = lambda n: b"".join(_field(1, _field(1, d) if d else _field(2, "n")) for d in n)
    tensor = lambda name, kind, shape: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, dims(shape))))
    attribute = lambda name, n: _field(5, _field(1, name) + _field(3, n) + _field(20, 2))
    node = _field(1, "float_input") + _field(2, "label") + _field(4, "ArgMax") + attribute("axis", 1) + attribute("keepdims", 0)
    graph = _field(1, node) + _field(2, "g") + _field(11, tensor("float_input", 1, [0, 4])) + _field(12, tensor("label", 7, [0]))
    model = _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))
    df = spark.createDataFrame([("a", 1.0, 5.0, 2.0, 3.0), ("b", 0.0, -1.0, -2.0, 4.0)], "taxon STRING, f_coverage FLOAT, f_strength FLOAT, f_depth FLOAT, f_share FLOAT")
    assert {r["taxon"]: r["prediction"] for r in features.predict_presence(df, model).collect()} == {"a": 1, "b": 3}
    assert features.predict_presence(df.limit(0), model).count() == 0


def test_single_tag_stats(spark):
    site = "T" * 6 + "GGGAC" + "T" * 14
    rows = [("s", site, "I" * 25), ("s", site, "!" * 25), ("s", "ACGT", "IIII"), ("s", None, None), ("t", "A", None)]
    got = digest.single_tag_stats(spark.createDataFrame(rows, "sample STRING, seq STRING, qual STRING"), "sample", "BslFI", qual="qual", quality=ReadQuality())
    assert {tuple(r) for r in got.collect()} == {("s", "BslFI", 4, 2, 1, "25.00%"), ("t", "BslFI", 1, 0, 0, "0.00%")}


def test_selected_lineages(spark):
    selected = spark.createDataFrame([("s", "g2"), ("s", "g1"), ("s", "g1"), ("t", "g9")], "sample STRING, gcf_id STRING")
    genomes = spark.createDataFrame([("g1", ["a"]), ("g2", ["b"])], "gcf_id STRING, taxonomy ARRAY<STRING>")
    assert [tuple(r) for r in profile.selected_lineages(selected, genomes).collect()] == [("s", "g1", ["a"]), ("s", "g2", ["b"])]


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
@pytest.mark.parametrize("split", [7, 64, 1000])
def test_plain_files_in_many_parts(spark, tmp_path, kind, split):
    """Every record comes once, in its order, wherever the parts begin; qualities may look like headers."""
    fastx.register(spark)
    r = random.Random(split)
    records, text = [], "\n" if kind == "fasta" else ""
    for i in range(120):
        seq = "".join(r.choice("ACGTN") for _ in range(r.randrange(0, 60)))
        if kind == "fasta":
            records.append((f"c{i} >x", seq, None))
            text += f">c{i} >x\n" + "".join(seq[k : k + 25] + "\r\n" for k in range(0, len(seq), 25))
        else:
            quality = "".join(r.choice("@+>I") for _ in seq)
            records.append((f"r{i}", seq, quality))
            text += f"@r{i}\n{seq}\n+\n{quality}\n"
    path = tmp_path / f"x.{kind}"
    path.write_bytes(text.encode())
    df = spark.read.format("fastx").option("path", str(path)).option("split", split).load()
    got = sorted(df.collect(), key=lambda x: x["ordinal"])
    assert [(x["header"], x["seq"], x["qual"]) for x in got] == records
    assert df.select(F.spark_partition_id()).distinct().count() > 3
    assert [x["ordinal"] for x in got] == [text.index(("@" if kind == "fastq" else ">") + h) + 1 for h, *_ in records]


def test_broken_records_in_parts_raise(spark, tmp_path):
    fastx.register(spark)
    (tmp_path / "x.fq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(20)) + "@bad\nACGT\n+\nII\n" + "".join(f"@s{i}\nACGT\n+\nIIII\n" for i in range(20)))
    with pytest.raises(Exception, match="broken FASTQ record"):
        spark.read.format("fastx").option("path", str(tmp_path / "x.fq")).option("split", 300).load().collect()


def test_xz_input(spark, tmp_path):
    fastx.register(spark)
    with lzma.open(tmp_path / "x.fa.xz", "wt") as f:
        f.write(">a\nAC\nGT\n")
    assert [tuple(r)[1:] for r in spark.read.format("fastx").option("path", str(tmp_path)).load().collect()] == [(1, "a", "ACGT", None)]


def test_files_of_owners_replace_older_ones_and_leave_nothing_beside(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 3}", i, f"id{i}") for i in range(30)], "sample STRING, hash BIGINT, id STRING")
    for _ in range(2):
        done = sample_files.write_streams(rows, "sample", str(tmp_path), ".BcgI.iibsp", ["hash"]).collect()
        assert sorted(r["n_records"] for r in done) == [10, 10, 10]
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"s{i}.BcgI.iibsp" for i in range(3)]
    sample_files.write_tables(rows.withColumn("line", F.col("id")), F.concat(F.lit(f"{tmp_path}/t/"), F.col("sample"), F.lit(".tsv")), ["hash"], "#head").count()
    assert (tmp_path / "t/s1.tsv").read_text().splitlines() == ["#head", *[f"id{i}" for i in range(1, 30, 3)]]
