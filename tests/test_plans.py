"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from markerloom.plans import hygiene, tags, warehouse

CORE = {**hygiene.QUERIES, **tags.QUERIES, **warehouse.QUERIES}


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def read_schemas(text):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*)>", text)]


@pytest.mark.parametrize("name", ["p2_found", "p2_taxa", "p2_tags_by_listing", "p3_found", "p5_counts", "marker_all_levels", "marker_tpch", "database_markers", "sample_tag_depth", "merged_samples", "digest_all16_counts"])
def test_no_pairing_of_all_rows(spark, sf, name):
    text = plan(CORE[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_used(spark, sf):
    assert {"l_suppkey", "l_orderkey"} in read_schemas(plan(CORE["marker_tpch"](spark, sf)))
    assert {"taxon", "gcf_unique_tag_count"} in read_schemas(plan(CORE["p2_taxa"](spark, sf)))
    assert {"sample", "enzyme", "id", "hash"} in read_schemas(plan(CORE["sample_tag_depth"](spark, sf)))
    assert {"doc_id", "text"} in read_schemas(plan(CORE["digest_bcgi"](spark, sf)))


def test_filters_reach_the_scan(spark, sf):
    assert "IsNotNull(genome_path)" in plan(CORE["gcf_id_normalise"](spark, sf))
    assert "IsNotNull(sample)" in plan(CORE["sample_tag_depth"](spark, sf))


def test_one_pass_for_all_enzymes(spark, sf):
    text = plan(tags._cut(spark, sf, [e.name for e in tags.ENZYMES]))
    assert text.count("Scan parquet") == 2  # named in the tree and in its details


def test_joins_meet_compact_states(spark, sf):
    """Both sides of the eager join are aggregated below the join."""
    tree = plan(CORE["p2_tags_by_listing"](spark, sf)).split("\n\n")[0]
    assert re.search(r"Join.*", tree) and tree.count("HashAggregate") >= 5


@pytest.mark.parametrize("name", ["marker_all_levels", "marker_tpch", "database_markers"])
def test_uniqueness_gathers_no_tag(spark, sf, name):
    """No window over a tag's occurrences; its taxa are reduced in every task before the shuffle."""
    text = plan(CORE[name](spark, sf))
    assert "Window" not in text and "partial_min(xxhash64(taxon" in text


def test_entry_names():
    assert set(CORE) <= set(entry.queries())
