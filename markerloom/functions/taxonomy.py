"""Lineages: parsing, ranks, paths, accessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species", "strain")


def level_number(level: str | int) -> int:
    """1 for kingdom to 8 for strain, by name in any case or number."""
    if str(level).isdigit() and 1 <= int(level) <= len(RANKS):
        return int(level)
    if str(level).lower() in RANKS:
        return RANKS.index(str(level).lower()) + 1
    raise ValueError(f"unknown rank {level!r}; known: {', '.join(RANKS)}")


def rank_path(taxonomy: Column | str, level: str | int, clamp: bool = False) -> Column:
    """The first ranks up to ``level`` joined by tabs: what identifies a taxon. Null if a rank is missing or null; with ``clamp`` a shorter lineage is taken as it is."""
    k = level_number(level)
    ranks = F.slice(taxonomy, 1, k)
    whole = ~F.exists(ranks, lambda x: x.isNull())
    return F.when(whole if clamp else whole & (F.size(ranks) == k), F.concat_ws("\t", ranks))


def accession(name: Column | str) -> Column:
    """Genome id of a file name or path: base name, cut at ``_genomic``; of GCF_ and GCA_ names the first two parts."""
    c = F.col(name) if isinstance(name, str) else name
    base = F.substring_index(F.substring_index(c, "/", -1), "_genomic", 1)
    return F.when(base.startswith("GCF_") | base.startswith("GCA_"), F.substring_index(base, "_", 2)).otherwise(base)


def _stripped(lineage: Column | str) -> Column:
    parts = F.split(lineage, ";")
    return F.transform(parts, lambda x: F.when(F.instr(x, "__") > 0, F.regexp_replace(x, "^.*?__", "")).otherwise(x))


def parse_lineage(lineage: Column | str, genome: Column | str, strict: bool = False) -> Column:
    """Ranks of ``d__A;p__B;...``: prefixes dropped; short lineages are filled with ``<last>_strain`` up to seven ranks, the eighth is ``<species> <genome>``.

    ``strict`` drops blank parts, gives null below seven ranks and always makes the eighth up.
    """
    g = F.col(genome) if isinstance(genome, str) else genome
    ranks = _stripped(lineage)
    if strict:
        ranks = F.filter(F.transform(ranks, lambda x: F.trim(x)), lambda x: x != "")
        seven = F.slice(ranks, 1, 7)
        return F.when(F.size(ranks) >= 7, F.concat(seven, F.array(F.concat(F.element_at(seven, 7), F.lit(" "), g))))
    missing = F.greatest(F.lit(7) - F.size(ranks), F.lit(0))
    last = F.element_at(ranks, -1)
    # Each filled rank appends to the one before it.
    filled = F.concat(ranks, F.transform(F.sequence(F.lit(1), F.greatest(missing, F.lit(1))), lambda i: F.concat(last, F.repeat(F.lit("_strain"), i))))
    padded = F.when(missing > 0, filled).otherwise(ranks)
    return F.when(F.size(padded) == 7, F.concat(padded, F.array(F.concat(F.element_at(padded, 7), F.lit(" "), g)))).otherwise(padded)
