"""Registered queries against their SQL twins. RENTLOOM_ALL=1 runs every query."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, oracle_connection

USUAL = """
read_rates_json read_hierarchy_json assign_row_key parse_dates normalize_text_columns require_key_fields exclusion_ledger
trim_outliers trim_grouped_outliers dedupe_keep_first monthly_usd_price one_hot_wide reindex_addresses apply_translations
streetwise_change_by_district group_price_median order_categories sample_per_group bridge_tables upsert check_references
extract_all_components fuzzy_lookup similar_pairs resolve_region merge_providers spearman correlation_matrix correlation_matrix_with_gaps dunn_posthoc
box_summary infer_city feature_vectors
""".split()


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", list(oracle_sql()) if os.environ.get("RENTLOOM_ALL") else USUAL)
def test_query_equals_sql(spark, sf, con, name):
    assert compare(con, queries()[name](spark, sf), oracle_sql()[name]) in ("", "both empty")


def test_every_twin_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"province", "district", "mean_change", "std_change", "streets"}


@pytest.mark.parametrize("name", ["streetwise_change_by_district", "trim_outliers", "fuzzy_lookup", "within_bbox", "infer_city", "cohens_d", "dunn_posthoc"])
def test_no_nested_loop_joins(spark, sf, capsys, name):
    queries()[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
