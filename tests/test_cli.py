import argparse
import gzip
import random

import pytest
from pyspark.sql import functions as F

from markerloom import cli
from markerloom.operators import features
from markerloom.sources import files, tagstream

BASES = "ACGT"


def site(i):
    """A BcgI site with flanks that tell it apart."""
    digits = "".join(BASES[(i >> (2 * k)) & 3] for k in range(10))
    return f"{digits}CGAAAAAAATGC{digits[::-1]}"


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    """Two species of two genomes with 40 sites each, the first of which all share; two samples and a control."""
    d = tmp_path_factory.mktemp("study")
    r = random.Random(1)
    lines, lineages = [], []
    for g in range(4):
        path = d / f"GCF_00000000{g}.1_asm_genomic.fna"
        tags = [site(900), *[site(100 * (g // 2) + k) for k in range(40)]]
        path.write_text("".join(f">c{k} x\n{t}\n" for k, t in enumerate(tags)))
        ranks = ["k", "p", "c", "o", "f", "g", f"sp{g // 2}", f"st{g}"]
        lines.append("\t".join([f"GCF_00000000{g}.1", *ranks, str(path)]))
        lineages.append(f"GCF_00000000{g}.1_asm\td__k;p__p;c__c;o__o;f__f;g__g;s__sp{g // 2}\t{path}")
    (d / "genomes.tsv").write_text("# list\n" + "\n".join(lines) + "\n")
    (d / "lineages.tsv").write_text("accession\tgtdb_taxonomy\n" + "\n".join(lineages) + "\n")
    (d / "paths.tsv").write_text("".join(f"GCF_00000000{g}.1\t{d}/GCF_00000000{g}.1_asm_genomic.fna\n" for g in range(4)))
    reads = {"s1": [site(r.randrange(40)) for _ in range(200)] + [site(100)], "s2": [site(100 + r.randrange(40)) for _ in range(150)] + [site(5)] * 40, "ctl": [site(120 + k) for k in range(10)]}
    for s, tags in reads.items():
        half = len(tags) // 2
        for name, part in ((f"{s}_1.fq.gz", tags[:half]), (f"{s}_2.fq.gz", tags[half:])):
            with gzip.open(d / name, "wt") as f:
                f.write("".join(f"@{s}.{k} y\n{t}\n+\n{'I' * len(t)}\n" for k, t in enumerate(part)))
    (d / "samples.tsv").write_text("".join(f"{s}\t{d}/{s}_1.fq.gz\t{d}/{s}_2.fq.gz\n" for s in reads))
    (d / "ko.tsv").write_text("#Species\tK1\tK2\tK3\nsp0\t2\t1\t0\nsp1\t0\t1\t0\n")
    return d


def lines(path):
    return path.read_text().splitlines()


def test_steps_and_pipeline(spark, study):
    d = study
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("extract", "-l", d / "paths.tsv", "-t", 1, "-s", "BcgI", "--od", d / "digest", "--record-pos")
    assert lines(d / "digest/GCF_000000000.1.BcgI.stat.tsv") == ["sample\tenzyme\tinput_sequences\ttag_count\tpercent", "GCF_000000000.1\tBcgI\t41\t41\t100.00%"]
    with files.open_input(str(d / "digest/GCF_000000000.1.BcgI.pos.iibdb")) as f:
        assert sorted(i for _, i in tagstream.parse(f))[:2] == ["c0|0", "c10|0"]
    run("build-qual-db", "-l", d / "genomes.tsv", "-s", "bcgi", "-t", "species,genus", "-o", d / "db")
    run("build-qual-db", "-l", d / "lineages.tsv", "-s", "BcgI", "-o", d / "db2", "--pre-digested-dir", d / "digest")
    key = lambda p: sorted((r["hash"], r["gcf_id"]) for r in spark.read.format("tagdb").option("path", str(p)).load().collect())
    assert len(key(d / "db/BcgI.species.iibdb")) == 160 and key(d / "db/BcgI.species.iibdb") == key(d / "db2/BcgI.species.iibdb")
    assert len(key(d / "db/BcgI.genus.iibdb")) == 164  # the shared tag is of one genus
    run("extract", "-l", d / "samples.tsv", "-t", 2, "-s", "BcgI", "--od", d / "tags")
    assert lines(d / "tags/s1.BcgI.stat.tsv")[1] == "s1\tBcgI\t201\t201\t100.00%"
    (d / "tags.tsv").write_text("".join(f"{s}\t{d}/tags/{s}.BcgI.iibsp\n" for s in ("s1", "s2", "ctl")) + "gone\t/nowhere/x.iibsp\n")
    run("quantify", "-l", d / "tags.tsv", "-d", d / "db", "-s", "BcgI", "-o", d / "qual")
    table = lines(d / "qual/s1/s1.BcgI.xls")
    assert table[0].startswith("#Kingdom\tPhylum\tClass\tOrder\tFamily\tGenus\tSpecies\tTheoretical_Tag_Num\t")
    assert len(table) == 3 and table[1].split("\t")[6:8] == ["sp0", "40.00000000"] and table[2].split("\t")[8:11] == ["1", "2.50000000%", "1"]
    found = [x.split("\t")[7:] for x in lines(d / "qual/s1/s1.BcgI.GCF_detected.xls")]
    assert found[0][:2] == ["GCF_000000000.1", "40"] and found[2] == ["GCF_000000002.1", "40", "1", "0.0250"]
    assert (d / "qual/BcgI.detail").exists()
    run("find-genome", "-l", d / "samples.tsv", "-d", d / "db", "-q", d / "qual", "-o", d / "sdb")
    assert [x.split("\t")[0] for x in lines(d / "sdb/s1/sdb.list")] == ["GCF_000000000.1", "GCF_000000001.1"]
    assert [x.split("\t")[0] for x in lines(d / "sdb/s2/sdb.list")] == ["GCF_000000002.1", "GCF_000000003.1"]  # one tag 40 times over is not more than one tag
    run("build-quan-db", "-l", d / "sdb/s1/sdb.list", "-s", "BcgI", "-o", d / "sdb/s1/database", "--pre-digested-dir", d / "digest")
    assert len(key(d / "sdb/s1/database/BcgI.species.iibdb")) == 82  # alone, the shared tag is a marker as well
    (d / "merge.tsv").write_text("".join(f"{s}\t{d}/qual/{s}/{s}.BcgI.xls\n" for s in ("s1", "s2", "ctl")))
    run("merge", "-l", d / "merge.tsv", "-o", d / "merged", "-p", "x", "-c", "ctl")
    whole, kept = lines(d / "merged/x.all.xls"), lines(d / "merged/x.filtered.xls")
    assert whole[0].split("\t")[-3:] == ["s1", "s2", "ctl"] and len(whole) == 3 and whole[1].split("\t")[-1] == "0" and whole[2].split("\t")[-1] == "1"
    assert kept[0].split("\t")[-2:] == ["s1", "s2"] and [x.split("\t")[6] for x in kept[1:]] == ["sp0"]
    run("predict", "-a", d / "merged/x.all.xls", "-m", d / "ko.tsv", "-o", d / "merged", "-p", "x")
    functions = lines(d / "merged/x.func.xls")
    assert functions[0] == "#Function\ts1\ts2\tctl" and [x.split("\t")[0] for x in functions[1:]] == ["K1", "K2"] and functions[2].endswith("\t1.00000000")
    run("inspect", d / "db", d / "tags", "--distinct")
    run("pipeline", "-l", d / "samples.tsv", "--genome-list", d / "genomes.tsv", "--outdir", d / "all", "--ko-mapping", d / "ko.tsv", "--control", "ctl", "--resume", "yes")
    assert [x.split("\t")[6] for x in lines(d / "all/05_merge/Abundance_Stat.filtered.xls")[1:]] == ["sp0"]
    assert len(lines(d / "all/05_merge/Abundance_Stat.all.xls")) == 3 and (d / "all/05_merge/Abundance_Stat.func.xls").exists()
    with pytest.raises(ValueError, match="either a list or inputs"):
        run("extract", "-t", 1, "-s", "BcgI", "--od", d / "no")
    with pytest.raises(ValueError, match="enzyme file or a folder"):
        run("build-quan-db", "-l", d / "sdb/s1/sdb.list", "-s", "BcgI", "-o", d / "no")


def test_single_tag_reads(spark, tmp_path):
    (tmp_path / "r.fa").write_text(f">one full header\n{'T' * 6}GGGAC{'T' * 14}{'A' * 60}\n>two\nACGT\n")
    cli.main(["extract", "-i", str(tmp_path / "r.fa"), "--op", "s", "-t", "3", "-s", "BslFI", "--od", str(tmp_path)], spark)
    with files.open_input(str(tmp_path / "s.BslFI.iibsp")) as f:
        assert [i for _, i in tagstream.parse(f)] == ["one full header"]
    assert lines(tmp_path / "s.BslFI.stat.tsv")[1] == "s\tBslFI\t2\t1\t1\t50.00%"


def test_pipeline_in_two_parts(spark, study, caplog):
    """A database made by ``db-only`` serves ``sample-only`` in another folder, as does each other source of digests; all give what ``full`` gives."""
    d = study
    run = lambda *a: cli.main([str(x) for x in a], spark)
    common = ["--site", "BcgI", "--level", "species", "--gscore", 5, "--threads", 4, "--pc", 8, "--min-qual", 15, "--resume", "no", "--prefix", "x", "--ko-mapping", d / "ko.tsv"]
    run("pipeline", "--mode", "db-only", "--genome-list", d / "paths.tsv", "--taxonomy", d / "genomes.tsv", "--outdir", d / "p/db", *common)
    assert sorted(p.name for p in (d / "p/db/02_db_qual").iterdir()) == ["BcgI.enzyme.iibdb", "BcgI.species.iibdb", cli.CLASSIFICATION]
    (d / "more.tsv").write_text((d / "samples.tsv").read_text() + f"gone\t{d}/none_1.fq.gz\t{d}/none_2.fq.gz\n")
    with caplog.at_level("WARNING", "markerloom"):
        run("pipeline", "--mode", "sample-only", "--samples", d / "more.tsv", "--database", d / "p/db/02_db_qual", "--outdir", d / "p/samples", *common)
    assert "sample gone is left out" in caplog.text
    run("pipeline", "--samples", d / "samples.tsv", "--genome-list", d / "genomes.tsv", "--outdir", d / "p/full", *common)
    run("extract", "-l", d / "paths.tsv", "-t", 1, "-s", "BcgI", "--od", d / "p/digest")
    run("pipeline", "--samples", d / "samples.tsv", "--taxonomy", d / "genomes.tsv", "--pre-digested-dir", d / "p/digest", "--outdir", d / "p/pre", *common)
    run("pipeline", "--samples", d / "samples.tsv", "--taxonomy", d / "genomes.tsv", "-e", d / "p/db/02_db_qual/BcgI.enzyme.iibdb", "--outdir", d / "p/e", *common)
    want = {n: lines(d / "p/full" / n) for n in ("05_merge/x.all.xls", "05_merge/x.filtered.xls", "05_merge/x.func.xls", "04_quantify/s1/s1/s1.BcgI.xls", "qualitative/s2/s2.BcgI.xls")}
    assert want["05_merge/x.all.xls"][0].split("\t")[-3:] == ["s1", "s2", "ctl"] and len(want["05_merge/x.all.xls"]) == 3
    assert want["04_quantify/s1/s1/s1.BcgI.xls"][0] == f"#{cli._header('species')}\t{cli.METRICS}" and len(want["qualitative/s2/s2.BcgI.xls"]) == 3
    for other in ("samples", "pre", "e"):
        assert {n: lines(d / "p" / other / n) for n in want} == want, other
    for bad, message in (([], "list of samples"), (["--samples", d / "samples.tsv"], "give lineages"), (["--samples", d / "samples.tsv", "--taxonomy", d / "genomes.tsv", "--use-pear", "yes"], "merge them first")):
        with pytest.raises(ValueError, match=message):
            run("pipeline", "--outdir", d / "p/no", *bad)
    (d / "none.tsv").write_text("gone\t/nowhere/x.fq\n")
    with pytest.raises(ValueError, match="none of the files"):
        run("extract", "-l", d / "none.tsv", "-t", 2, "-s", "BcgI", "--od", d / "no")


def test_classify_keeps_rows_and_adds_labels(spark, tmp_path, monkeypatch):
    rows = ["k\ta\t10.00000000\t5\t50.00000000%\t20\t2.00000000\t4.00000000\t3\t10.00000000", "k\tb\t8.00000000\t0\t0.00000000%\t0\t0.00000000\t0.00000000\t0\t0.00000000"]
    (tmp_path / "in.xls").write_text(f"#Kingdom\tPhylum\t{cli.METRICS}\n" + "\n".join(rows) + "\n")
    (tmp_path / "m.onnx").write_bytes(b"model")
    seen = []

    def predict(df, model):
        seen.append((model, [c for c in features.NAMES if c in df.columns]))
        return df.withColumn("prediction", (F.col("sequenced_reads_num") > 0).cast("long"))

    monkeypatch.setattr(features, "predict_presence", predict)
    cli.main(["classify", "-i", str(tmp_path / "in.xls"), "-m", str(tmp_path / "m.onnx"), "-o", str(tmp_path / "out.xls")], spark)
    assert lines(tmp_path / "out.xls") == [f"#Kingdom\tPhylum\t{cli.METRICS}\tPrediction", rows[0] + "\t1", rows[1] + "\t0"]
    assert seen == [(b"model", list(features.NAMES))]


def test_convert_lineages(spark, tmp_path, caplog):
    good = "d__D;p__P;c__C;o__O;f__F;g__G;s__S t"
    (tmp_path / "in.tsv").write_text(f"accession\tgtdb_taxonomy\nGCF_000000001.1_x\t{good}\n# note\nGCF_000000002.1\td__D;p__P\nGCA_000000003.2\t{good};t__own\nlone\n")
    with caplog.at_level("WARNING", "markerloom"):
        cli.main(["convert-lineages", "-i", str(tmp_path / "in.tsv"), "-o", str(tmp_path / "out")], spark)
    with gzip.open(tmp_path / "out" / cli.CLASSIFICATION, "rt") as f:
        assert f.read().splitlines() == ["GCA_000000003.2\tD\tP\tC\tO\tF\tG\tS t\tS t GCA_000000003.2", "GCF_000000001.1\tD\tP\tC\tO\tF\tG\tS t\tS t GCF_000000001.1"]
    assert "GCF_000000002.1\td__D;p__P" in caplog.text and "lone" not in caplog.text


def test_inspect_reports_every_row(spark, tmp_path, monkeypatch):
    rows = spark.range(10_050).selectExpr("concat('f', id) AS file")
    monkeypatch.setattr(cli.collections, "describe_files", lambda *_: (rows, rows.selectExpr("file", "'bad' AS error")))
    cli.inspect_files(spark, argparse.Namespace(files=["x"], full=False, distinct=False, records=0, top=0, out_file=str(tmp_path / "r.tsv")))
    assert len(lines(tmp_path / "r.tsv")) == 2 * 10_050 + 1


def test_inspect_report(spark, tmp_path):
    db = spark.createDataFrame([(i, "gA" if i % 3 else "gB") for i in range(30)] + [(-1, "gB")], "hash BIGINT, gcf_id STRING").coalesce(1)
    db.write.format("tagdb").option("path", str(tmp_path / "BcgI.species.iibdb")).mode("append").save()
    with files.open_output(str(tmp_path / "s.BcgI.iibsp")) as f:
        f.write(b"".join(tagstream.pack(i, f"r{i}_tag1") for i in range(4)))
    (tmp_path / "broken.iibdb").write_bytes(b"IIBC\x09\x00\x00\x00")
    report = lambda *a: (cli.main(["inspect", str(tmp_path), "-o", str(tmp_path / "out.tsv"), *a], spark), [x.split("\t") for x in lines(tmp_path / "out.tsv")])[1]
    got = report("--full", "-n", "2", "-t", "1")
    assert [x[0] for x in got] == ["file", *[str(tmp_path / n) for n in ("BcgI.species.iibdb", "s.BcgI.iibsp")], "error", "record", "record", "record", "record", "genome", "genome"]
    assert got[-2][2:] == ["1", "gA", "20"] and got[-1][2:] == ["1", "r0_tag1", "1"] and got[6][2:] == ["1", "0", "r0_tag1"]
    plain = report("-n", "0")
    assert [x for x in plain if x[0] == "genome"] == [["genome", str(tmp_path / "BcgI.species.iibdb"), "1", "gB", ""], ["genome", str(tmp_path / "BcgI.species.iibdb"), "2", "gA", ""]]
    assert not [x for x in plain if x[0] == "record"]
