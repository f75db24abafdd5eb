"""Queries for the tag operators. The tables hold no sequences, so message texts stand in: letters are mapped to bases, in the
same way by both engines, a message is a genome with its language, source and id as lineage, and also a read of one of four samples."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enzymes import ENZYMES, catalog, enzyme
from ..functions import dna
from ..functions import taxonomy as tx
from ..operators import digest, features, inspect, markers, matrix, profile
from ..session import materialize, spread, table

MIXED = ("BcgI", "AlfI", "Hin4I")
_LETTERS = string.ascii_uppercase + string.ascii_lowercase
_BASES = "".join("ACGT"[i % 4] for i in range(26)) * 2


def _bases(text: str = "text"):
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), _LETTERS, _BASES)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """(gcf_id, sample, seq, lang, source) of each message with text."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source")).where("text IS NOT NULL")
    return docs.select(F.col("doc_id").cast("string").alias("gcf_id"), F.concat(F.lit("s"), F.pmod("doc_id", F.lit(4)).cast("string")).alias("sample"), _bases().alias("seq"), "lang", "source", "text")


def _genomes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    g = F.col("doc_id").cast("string")
    ranks = F.array("lang", F.lit("P"), F.lit("C"), F.lit("O"), F.lit("F"), F.concat(F.lit("g_"), F.substring("source", 1, 1)), F.col("source"), F.concat("source", F.lit(" "), g))
    return docs.select(g.alias("gcf_id"), ranks.alias("taxonomy"))


def _cut(spark, d, names=("BcgI",), keep=("gcf_id",)) -> DataFrame:
    return digest.digest(_docs(spark, d), list(keep), names)


def _digest_query(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _cut(spark, d, [name])

    return query


def enzyme_catalog(spark, d):
    return catalog(spark)


def digest_all16_counts(spark, d):
    docs = _docs(spark, d)
    per = docs.select(*[F.coalesce(F.size(dna.windows_of_both("seq", e)), F.lit(0)).cast("bigint").alias(e.name) for e in ENZYMES])
    totals = per.agg(*[F.coalesce(F.sum(e.name), F.lit(0)).alias(e.name) for e in ENZYMES])
    return totals.unpivot([], [e.name for e in ENZYMES], "enzyme", "n_tags")


def digest_first_tag(spark, d):
    return digest.first_tags(_docs(spark, d), ["gcf_id"], "BslFI").drop("passed")


def digest_positions(spark, d):
    at = digest.digest_positions(_docs(spark, d).select("gcf_id", "seq"), ["gcf_id"], "BcgI", size=4096)
    return at.select("gcf_id", "enzyme", F.col("pos").alias("pos0"), (F.col("pos") + 1).alias("pos1"), "tag")


def digest_tag_index(spark, d):
    """Sites numbered through each sample, its messages taken as contigs in order of their ids."""
    docs = _docs(spark, d).select("sample", F.col("gcf_id").cast("bigint").alias("ordinal"), "seq")
    at = digest.digest_positions(docs, ["sample", "ordinal"], "BcgI", one_based=True)
    return digest.numbered_sites(at, "sample").select("sample", "ordinal", F.col("pos").alias("pos1"), "tag_index", "tag")


def read_tag_ids(spark, d):
    return digest.read_tags(_docs(spark, d), ["sample"], "gcf_id", "AlfI")


def revcomp_canonical(spark, d):
    """Both strands of whole sequences."""
    return _docs(spark, d).select("gcf_id", dna.revcomp("seq").alias("other_strand"), dna.canonical("seq").alias("canonical"))


def tag_hash_fx(spark, d):
    tags = _cut(spark, d).select("tag").distinct()
    return tags.select("tag", dna.tag_hash("tag").alias("h")).select("tag", "h", dna.hash_hex("h").alias("hex"), dna.unsigned("h").cast("string").alias("unsigned"))


def digest_stats(spark, d):
    return digest.digest_stats(_docs(spark, d), "sample", "BcgI")


def _n_read():
    return F.upper(F.translate("text", "zqxZQX", "NNNNNN"))  # rare letters play the unknown bases


def qc_n_fraction(spark, d):
    return _docs(spark, d).select("gcf_id", dna.ReadQuality(max_n=0.003).few_n(_n_read()).alias("kept"))


def qc_n_absolute(spark, d):
    return _docs(spark, d).select("gcf_id", dna.ReadQuality(max_n=3).few_n(_n_read()).alias("kept"))


def qc_quality_percent(spark, d):
    props = table(spark, d, "events").select("event_id", "props")
    return props.select("event_id", dna.ReadQuality(min_quality=20, min_percent=60).good_quality("props").alias("kept"))


def _occurrences(spark, d, levels, names=("BcgI",)):
    return markers.tag_occurrences(_cut(spark, d, names), _genomes(spark, d), levels, ["enzyme"])


def _markers(spark, d, levels=("species",), names=("BcgI",), redundant=True):
    return markers.unique_markers(_occurrences(spark, d, levels, names), ["enzyme"], redundant)


def marker_species(spark, d):
    return _markers(spark, d).select("tag", "gcf_id", "taxon")


def marker_kingdom(spark, d):
    return _markers(spark, d, ["kingdom"]).select("tag", "gcf_id", "taxon")


def marker_all_levels(spark, d):
    found = _markers(spark, d, tx.RANKS)
    return found.groupBy("level").agg(F.count_distinct("tag").alias("n_tags"), F.count(F.lit(1)).alias("n_records"), F.count_distinct("gcf_id").alias("n_genomes"))


def marker_keep_redundant(spark, d):
    return _markers(spark, d, redundant=False).select("tag", "gcf_id", "taxon", "n")


def marker_genome_coverage(spark, d):
    return markers.genome_coverage(_markers(spark, d), _genomes(spark, d), ["enzyme"])


def theory_taxon(spark, d):
    return markers.taxon_theory(_markers(spark, d), ["enzyme"]).withColumn("theoretical_tag_num", F.round("theoretical_tag_num", 6))


def theory_gcf(spark, d):
    return markers.gcf_theory(_markers(spark, d), ["enzyme"]).select("enzyme", "taxon", "gcf_id", "theory")


def tag_depth(spark, d):
    return profile.tag_depth(_cut(spark, d, keep=["sample"]), ["sample", "enzyme"])


class Study:
    """The messages as genomes and as reads: cut once and written, as are the markers, since every later step uses both again."""

    def __init__(self, spark: SparkSession, d: str, names: tuple[str, ...] = ("BcgI",)):
        self.genomes = _genomes(spark, d)
        self.cut = materialize(_cut(spark, d, names, ["gcf_id", "sample"]), "digest")
        self.markers = materialize(markers.unique_markers(markers.tag_occurrences(self.cut, self.genomes, ["species"], ["enzyme"]), ["enzyme"]), "markers")
        self.depth = profile.tag_depth(self.cut, ["sample", "enzyme"])

    def profile(self, thresholds: profile.Thresholds = profile.Thresholds()) -> DataFrame:
        return profile.abundance(self.depth, self.markers, markers.taxon_theory(self.markers, ["enzyme"]), thresholds, db=["enzyme"])

    def detected(self) -> DataFrame:
        return profile.gcf_detected(self.depth, self.markers, markers.gcf_theory(self.markers, ["enzyme"]), db=["enzyme"])

    def selected(self) -> DataFrame:
        return profile.find_genomes(self.profile(), self.detected(), 2, 0)

    def own_markers(self) -> DataFrame:
        return materialize(markers.sample_markers(self.cut, self.selected(), self.genomes, "species"), "own-markers")

    def long(self) -> DataFrame:
        return matrix.normalise(self.profile(), decimals=8)


_RATIOS = ("theoretical_tag_num", "percent", "reads_per_theoretical", "reads_per_sequenced", "g_score", "relative_abundance")


def _rounded(df: DataFrame, columns=_RATIOS) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def abundance_full(spark, d):
    return _rounded(Study(spark, d).profile())


LIMITS = profile.Thresholds(g_score=2.0, tag_depth=1.0, percent=50.0, relative_abundance=2.0)


def abundance_filtered(spark, d):
    return _rounded(Study(spark, d).profile(LIMITS))


def gcf_detected(spark, d):
    return _rounded(Study(spark, d).detected(), ["fraction"]).orderBy("sample", "taxon", "gcf_id")


def find_genome(spark, d):
    return Study(spark, d).selected()


def multi_enzyme_union(spark, d):
    """Genomes selected with several enzymes: a taxon that passes in any admits its genomes in every one."""
    return Study(spark, d, MIXED).selected()


def multi_enzyme_combine(spark, d):
    return _rounded(Study(spark, d, MIXED).profile())


def quan_markers_per_sample(spark, d):
    return Study(spark, d).own_markers().select("sample", "tag", "gcf_id", "taxon")


def abundance_quantitative(spark, d):
    study = Study(spark, d)
    own = study.own_markers()
    return _rounded(profile.abundance(study.depth.drop("enzyme"), own, markers.taxon_theory(own, ["sample"]), db=["sample"]))


def merge_long(spark, d):
    return _rounded(Study(spark, d).long(), ["value"])


SAMPLES = ("s0", "s1", "s2", "s3")


def merge_pivot(spark, d):
    return _rounded(matrix.pivot(Study(spark, d).long(), SAMPLES), SAMPLES).orderBy("taxon")


def merge_filtered(spark, d):
    return _rounded(matrix.without_contamination(Study(spark, d).long(), "s3"), ["value"])


def _mapping(spark, d):
    """Shares and repeats of the mix targets as copies of two functions."""
    return matrix.unpivot(table(spark, d, "mix_targets").withColumnRenamed("source", "species"), ["species"], "function", "copies")


def predict_long(spark, d):
    return _rounded(matrix.predict(Study(spark, d).long(), _mapping(spark, d)), ["value"])


def predict_pivot(spark, d):
    return _rounded(matrix.pivot(matrix.predict(Study(spark, d).long(), _mapping(spark, d)), SAMPLES, "function"), SAMPLES)


def predict_matched(spark, d):
    return matrix.matched_species(Study(spark, d).long(), _mapping(spark, d).where("species != 'labops'"))


def classify_features(spark, d):
    f = features.classifier_features(Study(spark, d).profile())
    return f.select("sample", "taxon", *[F.round(F.col(n).cast("double"), 4).alias(n) for n in features.NAMES])


def inspect_counts(spark, d):
    return inspect.tag_counts(_cut(spark, d))


def inspect_top_genomes(spark, d):
    return inspect.top_groups(_cut(spark, d), k=10)


def inspect_preview(spark, d):
    return inspect.preview(_cut(spark, d).select("gcf_id", "tag"), ["tag", "gcf_id"], 5)


def stream_kind(spark, d):
    names = table(spark, d, "part").select(F.concat(F.col("p_name"), F.element_at(F.array(*map(F.lit, (".iibsp", ".pos.iibdb", ".iibdb"))), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))).alias("file"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.lit("GCF_1|0|chr|5|0|-")).otherwise(F.lit("chr:5")).alias("first_id"), "p_partkey")
    return names.select("p_partkey", inspect.stream_kind("file", "first_id").alias("kind"), inspect.group_key("first_id").alias("grp"))


def _lineages(g):
    """Lineage text of the ranks, and its ranks: as it stands, cut to six, and strict."""
    prefixes = F.slice(F.array(*[F.lit(p + "__") for p in "dpcofgst"]), 1, F.size("taxonomy"))
    text = F.concat_ws(";", F.zip_with("taxonomy", prefixes, lambda a, b: F.concat(b, a)))
    cut = F.substring_index(text, ";", 6)
    return g.select("gcf_id", text.alias("lineage"), F.concat_ws("|", tx.parse_lineage(text, "gcf_id")).alias("ranks"), F.concat_ws("|", tx.parse_lineage(cut, "gcf_id")).alias("filled"), F.coalesce(F.concat_ws("|", tx.parse_lineage(text, "gcf_id", strict=True)), F.lit("")).alias("strict_ranks"))


def gtdb_parse(spark, d):
    """Lineages of one to eight ranks made of the genome list's ranks; a null rank is written as an empty one (``g__``)."""
    g = table(spark, d, "genome_records").where("gcf_id IS NOT NULL AND size(taxonomy) >= 1").select("gcf_id", F.transform("taxonomy", lambda x: F.coalesce(x, F.lit(""))).alias("taxonomy"))
    return _lineages(g.distinct())


def gcf_id_normalise(spark, d):
    paths = table(spark, d, "genome_records").select("genome_path").where("genome_path IS NOT NULL").distinct()
    return paths.select("genome_path", tx.accession("genome_path").alias("gcf_id"))


def taxon_levels(spark, d):
    g = table(spark, d, "genome_records").where("gcf_id IS NOT NULL").select("gcf_id", "taxonomy").distinct()
    return g.select("gcf_id", *[tx.rank_path("taxonomy", r).alias(f"at_{r}") for r in ("kingdom", "genus", "species", "strain")])


def split_record_id(spark, d):
    ids = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(":"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(":7")).otherwise(F.lit(""))).alias("id"))
    contig, pos = inspect.split_place("id")
    return ids.select("s_suppkey", contig.alias("contig"), pos.alias("pos"))


def file_sizes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", inspect.human_bytes(F.floor(F.col("o_totalprice") * F.col("o_orderkey"))).alias("size"))


def unsigned_hash_render(spark, d):
    return table(spark, d, "write_tasks").where("hash IS NOT NULL").select("hash").distinct().select("hash", dna.unsigned("hash").cast("string").alias("unsigned"), dna.hash_hex("hash").alias("hex"))


_NAMED = (
    enzyme_catalog, digest_all16_counts, digest_first_tag, digest_positions, digest_tag_index, read_tag_ids, revcomp_canonical, tag_hash_fx, digest_stats, qc_n_fraction, qc_n_absolute, qc_quality_percent,
    marker_species, marker_kingdom, marker_all_levels, marker_keep_redundant, marker_genome_coverage, theory_taxon, theory_gcf, tag_depth, abundance_full, abundance_filtered, gcf_detected, find_genome,
    multi_enzyme_union, multi_enzyme_combine, quan_markers_per_sample, abundance_quantitative, merge_long, merge_pivot, merge_filtered, predict_long, predict_pivot, predict_matched, classify_features,
    inspect_counts, inspect_top_genomes, inspect_preview, stream_kind, gtdb_parse, gcf_id_normalise, taxon_levels, split_record_id, file_sizes, unsigned_hash_render,
)
QUERIES = {f"digest_{e.name.lower()}": _digest_query(e.name) for e in ENZYMES} | {f.__name__: f for f in _NAMED}

# The SQL side. DuckDB's regular expressions have no lookahead, so every window is tested by itself, in chunks of each text.
_S = f"""S AS (SELECT doc_id::VARCHAR AS gcf_id, 's' || (doc_id % 4) AS sample, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS seq, lang, source, text, doc_id FROM documents WHERE text IS NOT NULL)"""
_REV = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _windows(name: str) -> str:
    """CTEs W_<enzyme> (gcf_id, sample, enzyme, pos, w, tag)."""
    e = enzyme(name)
    n = e.tag_length
    return f"""K_{name} AS (SELECT gcf_id, sample, c * 500 AS off, substr(seq, c * 500 + 1, {499 + n}) AS ch FROM S, unnest(range(0, length(seq) // 500 + 1)) t(c)),
X_{name} AS (SELECT gcf_id, sample, off + p - 1 AS pos, substr(ch, p, {n}) AS w FROM K_{name}, unnest(range(1, 501)) u(p) WHERE regexp_full_match(substr(ch, p, {n}), '{e.either}')),
W_{name} AS (SELECT gcf_id, sample, '{name}' AS enzyme, pos, w, least(w, {_REV.format("w")}) AS tag FROM X_{name})"""


def _cutting(*names: str) -> str:
    return f"WITH {_S}, " + ", ".join(map(_windows, names)) + ", D AS (" + " UNION ALL ".join(f"SELECT * FROM W_{n}" for n in names) + ")"


_RANKED = """, G AS (SELECT gcf_id, [lang, 'P', 'C', 'O', 'F', 'g_' || substr(source, 1, 1), source, source || ' ' || gcf_id] AS taxonomy FROM S),
L AS (SELECT * FROM (VALUES (1, 'kingdom'), (2, 'phylum'), (3, 'class'), (4, 'order'), (5, 'family'), (6, 'genus'), (7, 'species'), (8, 'strain')) l(k, level)),
T AS (SELECT gcf_id, level, array_to_string(taxonomy[1:k], chr(9)) AS taxon FROM G, L WHERE len(list_filter(taxonomy[1:k], lambda x: x IS NULL)) = 0),
C AS (SELECT enzyme, tag, gcf_id, count(*) AS n FROM D GROUP BY ALL),
O AS (SELECT enzyme, level, tag, gcf_id, taxon, n FROM C JOIN T USING (gcf_id)),
U0 AS (SELECT enzyme, level, tag FROM O GROUP BY ALL HAVING count(DISTINCT taxon) = 1),
UA AS (SELECT O.* FROM O JOIN U0 USING (enzyme, level, tag)), U AS (SELECT * FROM UA WHERE n = 1)"""
_PROFILED = """, M AS (SELECT * FROM U WHERE level = 'species'),
TG AS (SELECT enzyme, taxon, gcf_id, sum(n)::BIGINT AS theory FROM M GROUP BY ALL), TT AS (SELECT enzyme, taxon, avg(theory) AS theoretical_tag_num FROM TG GROUP BY ALL),
R AS (SELECT sample, enzyme, tag, count(*) AS depth FROM D GROUP BY ALL),
H AS (SELECT sample, enzyme, taxon, tag, depth FROM R JOIN (SELECT DISTINCT enzyme, tag, taxon FROM M) USING (enzyme, tag)),
A0 AS (SELECT sample, enzyme, taxon, count(*) AS t, sum(depth)::BIGINT AS r, count(*) FILTER (depth > 1) AS t1 FROM H GROUP BY ALL),
A AS (SELECT sample, enzyme, taxon, coalesce(theoretical_tag_num, 0) AS theoretical_tag_num, t AS sequenced_tag_num, coalesce(t / nullif(theoretical_tag_num, 0), 0) * 100 AS percent, r AS sequenced_reads_num,
  coalesce(r / nullif(theoretical_tag_num, 0), 0) AS reads_per_theoretical, r / t AS reads_per_sequenced, t1 AS sequenced_tag_num_gt1, sqrt(t * r) AS g_score, r / sum(r) OVER (PARTITION BY sample, enzyme) * 100 AS relative_abundance
  FROM A0 LEFT JOIN TT USING (enzyme, taxon)),
GD AS (SELECT sample, enzyme, taxon, gcf_id, coalesce(theory, 0) AS theory, detected, coalesce(detected / nullif(theory, 0), 0) AS fraction FROM
  (SELECT sample, enzyme, taxon, gcf_id, count(DISTINCT tag) AS detected FROM R JOIN M USING (enzyme, tag) GROUP BY ALL) LEFT JOIN TG USING (enzyme, taxon, gcf_id)),
FG AS (SELECT DISTINCT sample, gcf_id, taxon FROM GD WHERE detected > 0 AND (sample, taxon) IN (SELECT (sample, taxon) FROM A WHERE round(g_score, 8) > 2)),
V AS (SELECT taxon, sample, round(reads_per_theoretical, 8) / sum(round(reads_per_theoretical, 8)) OVER (PARTITION BY sample) AS value FROM A)"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _RATIOS)
_A = f"SELECT sample, enzyme, taxon, sequenced_tag_num, sequenced_reads_num, sequenced_tag_num_gt1, {_ROUNDED} FROM A"
_ONE, _DB, _ALL = _cutting("BcgI"), _cutting("BcgI") + _RANKED, _cutting("BcgI") + _RANKED + _PROFILED
_MANY = _cutting(*MIXED) + _RANKED + _PROFILED
_QM = """, QO AS (SELECT sample, tag, gcf_id, taxon, n FROM (SELECT s.sample, D.tag, D.gcf_id, count(*) AS n FROM D JOIN (SELECT DISTINCT sample, gcf_id FROM FG) s ON s.gcf_id = D.gcf_id GROUP BY ALL) JOIN T USING (gcf_id) WHERE level = 'species'),
QM AS (SELECT QO.* FROM QO JOIN (SELECT sample, tag FROM QO GROUP BY ALL HAVING count(DISTINCT taxon) = 1) USING (sample, tag) WHERE n = 1)"""
_MAP = """, MP AS (SELECT source AS species, 'target_share' AS function, target_share AS copies FROM mix_targets UNION ALL SELECT source, 'max_repeats', max_repeats::DOUBLE FROM mix_targets),
F0 AS (SELECT sample, function, sum(value * copies) AS v FROM (SELECT split_part(taxon, chr(9), 7) AS species, sample, value FROM V WHERE value != 0) JOIN MP USING (species) GROUP BY ALL),
FN AS (SELECT function, sample, v / sum(v) OVER (PARTITION BY sample) AS value FROM F0)"""
_PIVOT = ", ".join(f"round(coalesce(sum(value) FILTER (sample = '{s}'), 0), 6) AS {s}" for s in SAMPLES)
_NTEXT = "upper(translate(text, 'zqxZQX', 'NNNNNN'))"
_NCOUNT = f"length({_NTEXT}) - length(replace({_NTEXT}, 'N', ''))"
_WORD = "list_reduce([ascii(substr(tag, {k} * 8 + 9 - j, 1))::UHUGEINT FOR j IN range(1, 9)], lambda a, b: a * 256 + b)"
_M64 = "18446744073709551616::UHUGEINT"


def _hash_step(h: str, k: int) -> str:
    return f"(xor(({h} * 32) % {_M64} + {h} // 576460752303423488::UHUGEINT, {_WORD.format(k=k)}) * 5871781006564002453::UHUGEINT) % {_M64}"


_HASH = f"""{_ONE}, Z AS (SELECT DISTINCT tag FROM D), H0 AS (SELECT tag, ({_WORD.format(k=0)} * 5871781006564002453::UHUGEINT) % {_M64} AS h FROM Z),
H1 AS (SELECT tag, {_hash_step("h", 1)} AS h FROM H0), H2 AS (SELECT tag, {_hash_step("h", 2)} AS h FROM H1), H3 AS (SELECT tag, {_hash_step("h", 3)} AS h FROM H2)
SELECT tag, (CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END)::BIGINT AS h, lpad(lower(to_hex(h::UBIGINT)), 16, '0') AS hex, h::VARCHAR AS "unsigned" FROM H3"""

SQL = {f"digest_{e.name.lower()}": _cutting(e.name) + " SELECT gcf_id, enzyme, tag FROM D" for e in ENZYMES} | {
    "enzyme_catalog": "SELECT * FROM (VALUES " + ", ".join(f"({e.id}, '{e.name}', {e.tag_length}, '{e.forward}', '{e.reverse}')" for e in ENZYMES) + ") t(id, name, tag_length, fwd, rev)",
    "digest_all16_counts": _cutting(*[e.name for e in ENZYMES]) + ", N AS (SELECT unnest([" + ", ".join(f"'{e.name}'" for e in ENZYMES) + "]) AS enzyme) SELECT enzyme, count(tag) AS n_tags FROM N LEFT JOIN D USING (enzyme) GROUP BY 1",
    "digest_first_tag": f"""WITH {_S}, X AS (SELECT gcf_id, coalesce(nullif(regexp_extract(substr(seq, 1, 50), '{enzyme("BslFI").forward}'), ''), nullif(regexp_extract(substr(seq, 1, 50), '{enzyme("BslFI").reverse}'), '')) AS w FROM S)
      SELECT gcf_id, 'BslFI' AS enzyme, least(w, {_REV.format("w")}) AS tag FROM X WHERE w IS NOT NULL""",
    "digest_tag_index": _ONE + " SELECT sample, gcf_id::BIGINT AS ordinal, pos + 1 AS pos1, row_number() OVER (PARTITION BY sample ORDER BY gcf_id::BIGINT, pos) AS tag_index, tag FROM D",
    "digest_positions": _ONE + " SELECT gcf_id, enzyme, pos AS pos0, pos + 1 AS pos1, tag FROM D",
    "read_tag_ids": _cutting("AlfI") + " SELECT sample, gcf_id || '_tag' || row_number() OVER (PARTITION BY gcf_id ORDER BY pos) AS tag_id, enzyme, tag FROM D",
    "revcomp_canonical": f"WITH {_S} SELECT gcf_id, {_REV.format('seq')} AS other_strand, least(seq, {_REV.format('seq')}) AS canonical FROM S",
    "tag_hash_fx": _HASH,
    "digest_stats": _ONE + """, B AS (SELECT sample, count(*) AS c FROM D GROUP BY 1) SELECT sample, 'BcgI' AS enzyme, n AS input_sequences, coalesce(c, 0) AS tag_count, printf('%.2f%%', coalesce(c, 0) * 100.0 / n) AS percent
      FROM (SELECT sample, count(*) AS n FROM S GROUP BY 1) LEFT JOIN B USING (sample)""",
    "qc_n_fraction": f"SELECT doc_id::VARCHAR AS gcf_id, coalesce(({_NCOUNT}) / nullif(length({_NTEXT}), 0) <= 0.003, false) AS kept FROM documents WHERE text IS NOT NULL",
    "qc_n_absolute": f"SELECT doc_id::VARCHAR AS gcf_id, ({_NCOUNT}) <= 3 AS kept FROM documents WHERE text IS NOT NULL",
    "qc_quality_percent": r"SELECT event_id, coalesce(length(regexp_replace(props, '[^\x35-\x7e]', '', 'g')) * 100 // nullif(length(props), 0) >= 60, true) AS kept FROM events",
    "marker_species": _DB + " SELECT tag, gcf_id, taxon FROM U WHERE level = 'species'",
    "marker_kingdom": _DB + " SELECT tag, gcf_id, taxon FROM U WHERE level = 'kingdom'",
    "marker_all_levels": _DB + " SELECT level, count(DISTINCT tag) AS n_tags, count(*) AS n_records, count(DISTINCT gcf_id) AS n_genomes FROM U GROUP BY 1",
    "marker_keep_redundant": _DB + " SELECT tag, gcf_id, taxon, n FROM UA WHERE level = 'species'",
    "marker_genome_coverage": _DB + " SELECT enzyme, level, count(DISTINCT gcf_id) AS n_genomes, count(DISTINCT gcf_id) * 100 // (SELECT count(*) FROM S) AS percent FROM U WHERE level = 'species' GROUP BY 1, 2",
    "theory_taxon": _DB + " SELECT enzyme, level, taxon, round(avg(c), 6) AS theoretical_tag_num, count(*) AS n_genomes FROM (SELECT enzyme, level, taxon, gcf_id, sum(n) AS c FROM U WHERE level = 'species' GROUP BY ALL) GROUP BY ALL",
    "theory_gcf": _DB + " SELECT enzyme, taxon, gcf_id, sum(n)::BIGINT AS theory FROM U WHERE level = 'species' GROUP BY ALL",
    "tag_depth": _ONE + " SELECT sample, enzyme, tag, count(*) AS depth FROM D GROUP BY ALL",
    "abundance_full": f"{_ALL} {_A}",
    "abundance_filtered": f"{_ALL} {_A} WHERE g_score >= 2 AND reads_per_sequenced >= 1 AND percent >= 50 AND relative_abundance >= 2",
    "gcf_detected": _ALL + " SELECT sample, enzyme, taxon, gcf_id, theory, detected, round(fraction, 6) AS fraction FROM GD",
    "find_genome": _ALL + " SELECT * FROM FG",
    "multi_enzyme_union": _MANY + " SELECT * FROM FG",
    "multi_enzyme_combine": f"{_MANY} {_A}",
    "quan_markers_per_sample": _ALL + _QM + " SELECT sample, tag, gcf_id, taxon FROM QM",
    "abundance_quantitative": _ALL + _QM + f""", B1 AS (SELECT sample, taxon, avg(c) AS e FROM (SELECT sample, taxon, gcf_id, sum(n) AS c FROM QM GROUP BY ALL) GROUP BY ALL),
      B2 AS (SELECT sample, taxon, count(*) AS t, sum(depth)::BIGINT AS r, count(*) FILTER (depth > 1) AS t1 FROM R JOIN (SELECT DISTINCT sample, tag, taxon FROM QM) USING (sample, tag) GROUP BY ALL),
      AQ AS (SELECT sample, taxon, e AS theoretical_tag_num, t AS sequenced_tag_num, t / e * 100 AS percent, r AS sequenced_reads_num, r / e AS reads_per_theoretical, r / t AS reads_per_sequenced, t1 AS sequenced_tag_num_gt1, sqrt(t * r) AS g_score,
        r / sum(r) OVER (PARTITION BY sample) * 100 AS relative_abundance FROM B2 JOIN B1 USING (sample, taxon))
      SELECT sample, taxon, sequenced_tag_num, sequenced_reads_num, sequenced_tag_num_gt1, {_ROUNDED} FROM AQ""",
    "merge_long": _ALL + " SELECT taxon, sample, round(value, 6) AS value FROM V",
    "merge_pivot": f"{_ALL} SELECT taxon, {_PIVOT} FROM V GROUP BY taxon HAVING max(value) > 0",
    "merge_filtered": _ALL + " SELECT taxon, sample, round(value, 6) AS value FROM V WHERE sample != 's3' AND taxon NOT IN (SELECT taxon FROM V WHERE sample = 's3' AND value > 0)",
    "predict_long": _ALL + _MAP + " SELECT function, sample, round(value, 6) AS value FROM FN",
    "predict_pivot": f"{_ALL}{_MAP} SELECT function, {_PIVOT} FROM FN GROUP BY function",
    "predict_matched": _ALL + """ SELECT sample, count(*) AS n_species, count(*) FILTER (species IN (SELECT source FROM mix_targets WHERE source != 'labops')) AS n_matched
      FROM (SELECT DISTINCT sample, split_part(taxon, chr(9), 7) AS species FROM V WHERE value != 0) GROUP BY 1""",
    "classify_features": _ALL + """, Y AS (SELECT sample, taxon, greatest(sequenced_tag_num, 1)::DOUBLE AS s, greatest(sequenced_reads_num, 1)::DOUBLE AS r, greatest(theoretical_tag_num, 1)::DOUBLE AS t, greatest(sum(sequenced_reads_num) OVER (PARTITION BY sample), 1)::DOUBLE AS n FROM A)
      SELECT sample, taxon, round(ln(s / t)::FLOAT::DOUBLE, 4) AS f_coverage, round(ln(sqrt(s * r))::FLOAT::DOUBLE, 4) AS f_strength, round(ln(r / s)::FLOAT::DOUBLE, 4) AS f_depth, round(ln(r / s * t / n)::FLOAT::DOUBLE, 4) AS f_share FROM Y""",
    "inspect_counts": _ONE + " SELECT count(*) AS n_records, count(DISTINCT tag) AS n_tags, count(DISTINCT gcf_id) AS n_groups FROM D",
    "inspect_top_genomes": _ONE + " SELECT gcf_id, count(*) AS n_records FROM D GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "inspect_preview": _ONE + " SELECT gcf_id, tag FROM D ORDER BY tag, gcf_id LIMIT 5",
    "stream_kind": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'reads' WHEN 1 THEN 'positions' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'digest' ELSE 'contigs' END END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'GCF_1' ELSE 'chr:5' END AS grp FROM part""",
    "gtdb_parse": """WITH g AS (SELECT DISTINCT gcf_id, list_transform(taxonomy, lambda x: coalesce(x, '')) AS t FROM genome_records WHERE gcf_id IS NOT NULL AND len(taxonomy) >= 1),
      h AS (SELECT *, t[1:6] AS c, [x FOR x IN t IF trim(x) <> ''] AS w FROM g),
      l AS (SELECT *, list_concat(t, [t[-1] || repeat('_strain', i) FOR i IN range(1, 8 - len(t))]) AS p, list_concat(c, [c[-1] || repeat('_strain', i) FOR i IN range(1, 8 - len(c))]) AS f FROM h)
      SELECT gcf_id, array_to_string([substr('dpcofgst', i, 1) || '__' || t[i] FOR i IN range(1, len(t) + 1)], ';') AS lineage, array_to_string(CASE WHEN len(p) = 7 THEN list_append(p, p[7] || ' ' || gcf_id) ELSE p END, '|') AS ranks,
        array_to_string(list_append(f, f[7] || ' ' || gcf_id), '|') AS filled, CASE WHEN len(w) >= 7 THEN array_to_string(list_append(w[1:7], w[7] || ' ' || gcf_id), '|') ELSE '' END AS strict_ranks FROM l""",
    "gcf_id_normalise": """SELECT genome_path, CASE WHEN b LIKE 'GCF\\_%' ESCAPE '\\' OR b LIKE 'GCA\\_%' ESCAPE '\\' THEN split_part(b, '_', 1) || '_' || split_part(b, '_', 2) ELSE b END AS gcf_id
      FROM (SELECT DISTINCT genome_path, split_part(split_part(genome_path, '/', -1), '_genomic', 1) AS b FROM genome_records WHERE genome_path IS NOT NULL)""",
    "taxon_levels": "SELECT gcf_id, " + ", ".join(f"CASE WHEN len(taxonomy) >= {k} AND len(list_filter(taxonomy[1:{k}], lambda x: x IS NULL)) = 0 THEN array_to_string(taxonomy[1:{k}], chr(9)) END AS at_{tx.RANKS[k - 1]}" for k in (1, 6, 7, 8)) + " FROM (SELECT DISTINCT gcf_id, taxonomy FROM genome_records WHERE gcf_id IS NOT NULL)",
    "split_record_id": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ':' || s_suppkey ELSE s_name END AS contig, CASE WHEN s_suppkey % 2 = 0 THEN '7' ELSE s_suppkey::VARCHAR END AS pos FROM supplier",
    "file_sizes": """SELECT o_orderkey, CASE WHEN b >= 1024.0^4 THEN printf('%.2f TB', b / 1024.0^4) WHEN b >= 1024.0^3 THEN printf('%.2f GB', b / 1024.0^3) WHEN b >= 1024.0^2 THEN printf('%.2f MB', b / 1024.0^2) WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0) ELSE printf('%.0f B', b) END AS size
      FROM (SELECT o_orderkey, floor(o_totalprice * o_orderkey) AS b FROM orders)""",
    "unsigned_hash_render": "SELECT DISTINCT hash, (CASE WHEN hash < 0 THEN hash::HUGEINT + 18446744073709551616::HUGEINT ELSE hash::HUGEINT END)::VARCHAR AS \"unsigned\", lpad(lower(to_hex(hash)), 16, '0') AS hex FROM write_tasks WHERE hash IS NOT NULL",
}
