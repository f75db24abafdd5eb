"""Cutting sequences in silico into tags."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..enzymes import Enzyme, enzyme
from ..functions import dna
from ..session import present

#: Starts held by one chunk of a long sequence.
CHUNK = 1 << 20
#: Reads of single-tag libraries are cut to this length first.
SINGLE_TAG_READ = 50


def digest(seqs: DataFrame, keep: Sequence[str], enzymes: Sequence[str | int], seq: str = "seq", size: int = CHUNK) -> DataFrame:
    """One row (keep, enzyme, tag) for each site on either strand, overlaps included; ``tag`` is canonical.

    Lower-case bases count as upper-case; a window with any other letter gives no tag; null and short sequences give none. A sequence of more
    than ``size`` letters is cut in overlapping chunks of which each offset starts in exactly one, so that no more is searched at once.
    """
    # All enzymes cut a sequence in one pass over the input.
    chosen = [enzyme(x) for x in enzymes]
    long = F.octet_length("cut_seq") > size
    starts = F.when(long, F.sequence(F.lit(0), F.floor((F.octet_length("cut_seq") - 1) / size).cast("int"))).otherwise(F.array(F.lit(0)))
    rows = seqs.select(*keep, F.upper(seq).alias("cut_seq")).withColumn("cut_at", F.explode(starts))
    chunk = F.when(long, F.substring("cut_seq", F.col("cut_at") * size + 1, F.lit(size + max((e.tag_length for e in chosen), default=1) - 1))).otherwise(F.col("cut_seq"))
    rows = rows.select(*keep, chunk.alias("cut_seq"))
    # A shorter window must not start in the part that the next chunk has as well.
    part = lambda e: F.when(long, F.substring("cut_seq", F.lit(1), F.lit(size + e.tag_length - 1))).otherwise(F.col("cut_seq"))
    sites = F.array(*[F.struct(F.lit(e.name).alias("enzyme"), dna.windows_of_both(part(e), e).alias("ws")) for e in chosen])
    per = rows.select(*keep, F.explode(sites).alias("cut"))
    out = per.select(*keep, F.col("cut.enzyme").alias("enzyme"), F.explode("cut.ws").alias("w"))
    return out.select(*keep, "enzyme", dna.canonical("w").alias("tag"))


def first_tags(reads: DataFrame, keep: Sequence[str], key: str | int, seq: str = "seq", qual: str | None = None, quality: dna.ReadQuality | None = None) -> DataFrame:
    """Single-tag libraries: the first site of each read's first 50 bases, its qualities judged on the window; (keep, enzyme, tag, passed)."""
    e = enzyme(key)
    cut = reads.select(*keep, *([F.col(qual).alias("cut_qual")] if qual else []), F.substring(F.upper(seq), 1, SINGLE_TAG_READ).alias("cut_seq"))
    found = cut.withColumn("w", dna.first_window("cut_seq", e)).where("w IS NOT NULL")
    passed = F.lit(True)
    if quality is not None and qual:
        at = F.instr("cut_seq", F.col("w"))
        window = F.substring("cut_qual", at, F.lit(e.tag_length))
        passed = F.when(F.length(window) == e.tag_length, quality.good_quality(window)).otherwise(F.lit(True))
    return found.select(*keep, F.lit(e.name).alias("enzyme"), dna.canonical("w").alias("tag"), passed.alias("passed"))


def read_tags(reads: DataFrame, keep: Sequence[str], read_id: str, key: str | int, seq: str = "seq") -> DataFrame:
    """Shotgun reads: every site with the id ``<read>_tag<i>``, i counting from 1 by offset; the read is the first word of its header."""
    e = enzyme(key)
    named = reads.select(*keep, F.regexp_extract(F.col(read_id).cast("string"), r"^\S+", 0).alias("read_name"), F.posexplode(dna.all_windows(F.upper(seq), e)).alias("at", "w"))
    return named.select(*keep, F.concat("read_name", F.lit("_tag"), (F.col("at") + 1).cast("string")).alias("tag_id"), F.lit(e.name).alias("enzyme"), dna.canonical("w").alias("tag"))


def chunk_sequences(seqs: DataFrame, keep: Sequence[str], key: str | int, seq: str = "seq", size: int = CHUNK) -> DataFrame:
    """Long sequences as overlapping chunks (keep, chunk_start, chunk), so that each offset starts in exactly one chunk and the chunks of one contig spread over tasks."""
    length = enzyme(key).tag_length
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("cut_seq") - 1) / size), F.lit(0)).cast("int"))
    rows = seqs.select(*keep, F.upper(seq).alias("cut_seq")).where("cut_seq IS NOT NULL").withColumn("c", F.explode(starts))
    return rows.select(*keep, (F.col("c").cast("bigint") * size).alias("chunk_start"), F.substring("cut_seq", F.col("c") * size + 1, F.lit(size + length - 1)).alias("chunk"))


def _site_task(keep: list[str], e: Enzyme):
    strands = [re.compile(r) for r in e.anchored]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, window = [], [], []
            for i, (start, chunk) in enumerate(zip(batch.column("chunk_start").to_pylist(), batch.column("chunk").to_pylist(), strict=True)):
                sites = {m.start(1): m.group(1) for site in strands for m in site.finditer(chunk)}
                for offset in sorted(sites):
                    at.append(i)
                    pos.append(start + offset)
                    window.append(sites[offset])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in keep], pa.array(pos, pa.int64()), pa.array(window, pa.string())], names=[*keep, "pos", "w"])

    return run


def digest_positions(seqs: DataFrame, keep: Sequence[str], key: str | int, seq: str = "seq", one_based: bool = False, size: int = CHUNK) -> DataFrame:
    """Sites with their place: (keep, enzyme, pos, tag), pos from 0 or from 1."""
    e, keep = enzyme(key), list(keep)
    types = dict(seqs.select(*keep).dtypes)
    sites = chunk_sequences(seqs, keep, e, seq, size).mapInArrow(_site_task(keep, e), ", ".join([*[f"`{k}` {types[k]}" for k in keep], "pos BIGINT", "w STRING"]))
    return sites.select(*keep, F.lit(e.name).alias("enzyme"), (F.col("pos") + int(one_based)).alias("pos"), dna.canonical("w").alias("tag"))


def numbered_sites(sites: DataFrame, genome: str = "gcf_id", contig: str = "ordinal", pos: str = "pos") -> DataFrame:
    """Adds ``tag_index``, the running number from 1 of each site of a genome, by contig and position.

    Sites are ordered within their contig only; the contigs' counts, a row each, give what lies before. Sites without genome or contig are left out.
    """
    sites = present(sites, genome, contig)
    counts = sites.groupBy(genome, contig).agg(F.count(F.lit(1)).alias("contig_sites"))
    before = F.sum("contig_sites").over(W.partitionBy(genome).orderBy(contig).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(genome, contig, F.coalesce(before, F.lit(0)).alias("sites_before"))
    local = sites.withColumn("site_of_contig", F.row_number().over(W.partitionBy(genome, contig).orderBy(pos)))
    numbered = local.join(starts, [genome, contig]).withColumn("tag_index", (F.col("sites_before") + F.col("site_of_contig")).cast("bigint"))
    return numbered.select(*sites.columns, "tag_index")


def genome_digest(contigs: DataFrame, key: str | int, genome: str = "gcf_id", header: str = "header", ordinal: str = "ordinal", seq: str = "seq") -> DataFrame:
    """Tags of reference genomes: gcf_id, contig (first word of the header, else ``contig<ordinal>``), pos from 0, tag."""
    word = F.regexp_extract(F.coalesce(header, F.lit("")), r"^\S+", 0)
    named = contigs.select(F.col(genome).alias("gcf_id"), F.when(word != "", word).otherwise(F.concat(F.lit("contig"), F.col(ordinal).cast("string"))).alias("contig"), F.col(seq).alias("seq"))
    return digest_positions(named, ["gcf_id", "contig"], key)


def digest_stats(seqs: DataFrame, sample: str, key: str | int, seq: str = "seq", qual: str | None = None, quality: dna.ReadQuality | None = None) -> DataFrame:
    """Sequences (before the read filter), tags (after it) and tags per 100 sequences, as text with two decimals, for each sample."""
    e = enzyme(key)
    ok = F.lit(True)
    if quality is not None:
        ok = quality.few_n(seq) & (quality.good_quality(qual) if qual else F.lit(True))
    tags = F.when(ok, F.size(dna.windows_of_both(F.upper(seq), e))).otherwise(0)
    per = seqs.select(F.col(sample).alias("sample"), F.coalesce(F.greatest(tags, F.lit(0)), F.lit(0)).alias("t")).groupBy("sample").agg(F.count(F.lit(1)).alias("input_sequences"), F.sum("t").cast("bigint").alias("tag_count"))
    percent = F.coalesce(F.try_divide(F.col("tag_count") * 100.0, F.col("input_sequences").cast("double")), F.lit(0.0))
    return per.select("sample", F.lit(e.name).alias("enzyme"), "input_sequences", "tag_count", F.format_string("%.2f%%", percent).alias("percent"))


def single_tag_stats(reads: DataFrame, sample: str, key: str | int, seq: str = "seq", qual: str | None = None, quality: dna.ReadQuality | None = None) -> DataFrame:
    """Single-tag libraries: reads, reads with a site, those of them that pass the read filter, and their percentage of all reads."""
    work = reads.select(F.col(sample).alias("sample"), F.col(seq).alias("read_seq"), (F.col(qual) if qual else F.lit(None).cast("string")).alias("read_qual"))
    found = first_tags(work, ["sample"], key, "read_seq", "read_qual", quality).groupBy("sample").agg(F.count(F.lit(1)).alias("found"), F.count_if("passed").alias("passed"))
    per = work.groupBy("sample").agg(F.count(F.lit(1)).alias("input_reads_num")).join(found, "sample", "left")
    good = F.coalesce("passed", F.lit(0))
    percent = F.coalesce(F.try_divide(good * 100.0, F.col("input_reads_num").cast("double")), F.lit(0.0))
    return per.select("sample", F.lit(enzyme(key).name).alias("enzyme"), "input_reads_num", F.coalesce("found", F.lit(0)).alias("enzyme_reads_num"), good.alias("qc_reads_num"), F.format_string("%.2f%%", percent).alias("percent"))
