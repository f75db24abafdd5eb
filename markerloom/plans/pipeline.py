"""From genomes and reads to profiles, as one lazy composition of the operators.

All samples, enzymes and ranks go through the same joins and aggregations; there is no loop over samples. Stages can be
kept as Parquet, each beside a fingerprint of its inputs, so that a later run takes up what is already there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.dna import ReadQuality
from ..operators import digest, markers, matrix, profile


@dataclass(frozen=True)
class Settings:
    enzymes: tuple[str, ...] = ("BcgI",)
    level: str = "species"
    drop_redundant: bool = True
    quality: ReadQuality = field(default_factory=ReadQuality)
    g_score: float = 5.0
    min_tags: int = 1
    thresholds: profile.Thresholds = field(default_factory=profile.Thresholds)
    mocks: str = ""
    controls: str = ""
    #: Round ratios to 8 decimals before merging, as profiles passed on as text are.
    as_text: bool = False


@dataclass(frozen=True)
class Database:
    """Digest of the genomes, its markers and their theory."""

    digest: DataFrame
    genomes: DataFrame
    markers: DataFrame
    theory: DataFrame
    #: Tags are hashes, as files keep them, not words.
    hashed: bool = False


class Stages:
    """Stage results under a folder: ``<folder>/<stage>-<fingerprint>``; with ``reuse`` a folder with ``_SUCCESS`` is read instead of being made again."""

    def __init__(self, spark: SparkSession, folder: str | None, inputs: object = None, reuse: bool = True):
        self.spark, self.folder, self.reuse = spark, folder.rstrip("/") if folder else None, reuse
        self.mark = hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:16]

    def _done(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def keep(self, stage: str, make: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
        if self.folder is None:
            return make()
        path = f"{self.folder}/{stage}-{self.mark}"
        if not (self.reuse and self._done(path)):
            writer = make().write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.parquet(path)


def build_database(contigs: DataFrame | None, genomes: DataFrame, settings: Settings, stages: Stages, tags: DataFrame | None = None, ready: DataFrame | None = None) -> Database:
    """Database of all genomes: ``contigs`` (gcf_id, seq), ``genomes`` (gcf_id, taxonomy). Raises if no genome gives a tag, names genomes without sequence in ``unread_genomes``.

    ``tags`` (gcf_id, enzyme, tag as hash) is a digest made before and takes the place of ``contigs``, ``ready`` (enzyme, level, tag, gcf_id, taxon, n)
    the markers of a database made before, which come with its digest.
    """
    cut = stages.keep("digest", lambda: tags if tags is not None else digest.digest(contigs, ["gcf_id"], settings.enzymes), ["enzyme"])
    if cut.isEmpty():
        raise ValueError("no genome gives a tag: are the sequences there?")
    found = stages.keep("markers", lambda: ready if ready is not None else markers.unique_markers(markers.tag_occurrences(cut, genomes, [settings.level], ["enzyme"]), ["enzyme"], settings.drop_redundant), ["enzyme", "level"])
    if found.isEmpty():
        raise ValueError("no tag occurs in one taxon only")
    return Database(cut, genomes, found, markers.taxon_theory(found, ["enzyme"]), tags is not None)


def unread_genomes(contigs: DataFrame, genomes: DataFrame) -> DataFrame:
    """Listed genomes without any sequence: a warning to report, not an error."""
    return genomes.select("gcf_id").dropna().distinct().join(contigs.select("gcf_id").distinct(), "gcf_id", "left_anti")


def sample_depth(reads: DataFrame, settings: Settings, hashed: bool = False) -> DataFrame:
    """Tag depths (sample, enzyme, tag, depth) of reads (sample, seq, qual) that pass the read filter."""
    good = reads.where(settings.quality.few_n("seq") & settings.quality.good_quality("qual"))
    cut = digest.digest(good, ["sample"], settings.enzymes)
    return profile.tag_depth(cut.withColumn("tag", dna.tag_hash("tag")) if hashed else cut, ["sample", "enzyme"])


def profile_samples(reads: DataFrame, db: Database, settings: Settings, stages: Stages) -> dict[str, DataFrame]:
    """Detection against the whole database without thresholds, then quantification against each sample's own genomes with them; both, with the selection."""
    depth = stages.keep("depth", lambda: sample_depth(reads, settings, db.hashed))
    rough = stages.keep("qualitative", lambda: profile.abundance(depth, db.markers, db.theory, by=["sample"], db=["enzyme"]))
    detected = stages.keep("detected", lambda: profile.gcf_detected(depth, db.markers, markers.gcf_theory(db.markers, ["enzyme"]), db=["enzyme"]))
    selected = stages.keep("selected", lambda: profile.find_genomes(rough, detected, settings.g_score, settings.min_tags))
    own = stages.keep("own-markers", lambda: own_markers(db, selected, settings))
    fine = stages.keep("quantitative", lambda: profile.abundance(depth, own, markers.taxon_theory(own, ["sample", "enzyme"]), settings.thresholds, by=["sample"], db=["sample", "enzyme"]))
    return {"depth": depth, "qualitative": rough, "detected": detected, "selected": selected, "own_markers": own, "quantitative": fine}


def own_markers(db: Database, selected: DataFrame, settings: Settings) -> DataFrame:
    mine = db.digest.select("enzyme", "tag", "gcf_id").join(selected.select("sample", "gcf_id").distinct(), "gcf_id")
    return markers.unique_markers(markers.tag_occurrences(mine, db.genomes, [settings.level], ["sample", "enzyme"], clamp=True), ["sample", "enzyme"], settings.drop_redundant)


def merge_samples(profiles: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Long matrices of all samples, and of samples other than mocks and controls without the controls' taxa."""
    one = profiles.groupBy("sample", "taxon").agg(F.sum("reads_per_theoretical").alias("reads_per_theoretical"))
    long = matrix.normalise(one, decimals=8 if settings.as_text else None)
    return long, matrix.without_contamination(long, settings.controls, settings.mocks)


def run(
    contigs: DataFrame | None, genomes: DataFrame, reads: DataFrame | None, settings: Settings = Settings(), folder: str | None = None, mapping: DataFrame | None = None, inputs: object = None, mode: str = "full",
    sample_inputs: object = None, reuse: bool = True, tags: DataFrame | None = None, ready: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``full``, ``db-only`` (contigs and genomes alone) or ``sample-only`` (the database must be given as ``tags`` and ``ready``, or be in ``folder`` already).

    ``inputs`` names what the database is made from, ``sample_inputs`` what the profiles are made from besides; with the
    settings they are the stages' fingerprints. Without ``reuse`` stages are made anew, but for the database of ``sample-only``.
    ``tags`` and ``ready``: see :func:`build_database`.
    """
    if mode not in ("full", "db-only", "sample-only"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = genomes.sparkSession
    base = Stages(spark, folder, ["database", inputs, settings.enzymes, settings.level, settings.drop_redundant, tags is not None, ready is not None], reuse or mode == "sample-only")
    if mode == "sample-only" and ready is None and (folder is None or not base._done(f"{base.folder}/markers-{base.mark}")):
        raise ValueError("sample-only needs a database: one given, or one made before in the same folder")
    db = build_database(contigs, genomes, settings, base, tags, ready)
    out = {"digest": db.digest, "markers": db.markers, "theory": db.theory}
    if mode == "db-only":
        return out
    out |= profile_samples(reads, db, settings, Stages(spark, folder, ["samples", inputs, sample_inputs, settings, tags is not None, ready is not None], reuse))
    out["merged"], out["filtered"] = merge_samples(out["quantitative"], settings)
    if mapping is not None:
        out["functions"] = matrix.predict(out["merged"], mapping)
    return out
