"""Looking into tag collections: totals, largest groups, previews, what kind of record a file holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..enzymes import ENZYMES
from ..functions.taxonomy import RANKS


def stream_kind(file_name: Column | str, first_id: Column | str) -> Column:
    """``reads``, ``positions``, ``digest`` or ``contigs``, by the file's ending or else the form of its first id."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    first = F.col(first_id) if isinstance(first_id, str) else first_id
    return F.when(name.endswith(".iibsp"), "reads").when(name.endswith(".pos.iibdb"), "positions").when(first.contains("|"), "digest").otherwise("contigs")


def group_key(record_id: Column | str) -> Column:
    """What a record belongs to: the text before the first bar."""
    return F.substring_index(record_id, "|", 1)


def split_place(record_id: Column | str) -> tuple[Column, Column]:
    """Contig and position of ``contig:pos``, split at the last colon; without one the whole id and 0."""
    c = F.col(record_id) if isinstance(record_id, str) else record_id
    has = F.instr(c, ":") > 0
    return F.when(has, F.regexp_extract(c, "^(.*):", 1)).otherwise(c), F.when(has, F.substring_index(c, ":", -1)).otherwise(F.lit("0"))


def tag_counts(tags: DataFrame, tag: str = "tag", group: str = "gcf_id") -> DataFrame:
    """Records, distinct tags and groups, exactly."""
    return tags.agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(tag).alias("n_tags"), F.count_distinct(group).alias("n_groups"))


def top_groups(tags: DataFrame, group: str = "gcf_id", k: int = 10, tie: str | None = None) -> DataFrame:
    """The ``k`` groups with the most records, equal ones by name, or by the smallest ``tie`` (such as the place in a genome list): a top-k report."""
    first = [F.min(tie).alias("tie")] if tie else []
    per = tags.groupBy(group).agg(F.count(F.lit(1)).alias("n_records"), *first)
    return per.orderBy(F.desc("n_records"), *(["tie"] if tie else []), F.asc(group)).limit(k).select(group, "n_records")


def preview(tags: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` records in a stated order."""
    return tags.orderBy(*order).limit(n)


def human_bytes(n: Column | str) -> Column:
    """A size with two decimals and its unit, B to TB."""
    c = F.col(n).cast("double") if isinstance(n, str) else n.cast("double")
    out = F.format_string("%.0f B", c)
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(c >= 1024.0**i, F.format_string(f"%.2f {unit}", c / 1024.0**i)).otherwise(out)
    return out


def name_hints(file_name: Column | str) -> tuple[Column, Column]:
    """Enzyme and rank that a file name such as ``BcgI.species.iibdb`` speaks of, or null."""
    c = F.col(file_name) if isinstance(file_name, str) else file_name
    parts = F.split(F.substring_index(c, "/", -1), r"\.")
    names = F.create_map(*[F.lit(x) for e in ENZYMES for x in (e.name.lower(), e.name)])
    known = F.filter(F.transform(parts, lambda x: F.try_element_at(names, F.lower(x))), lambda x: x.isNotNull())
    return F.try_element_at(known, F.lit(1)), F.try_element_at(F.filter(parts, lambda x: x.isin(*RANKS)), F.lit(1))
