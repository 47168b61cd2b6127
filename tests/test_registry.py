import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
# one or two queries of every section; set VANFLOW_ALL_QUERIES=1 for all of them
SAMPLE = [
    "A1_customer_data", "A5_incremental_merge", "A17_session_route_rows", "A19_session_window", "B3_build_panel",
    "B6_outlier_treatment", "C4_pair_explainability", "D13_class_features", "E4_croston", "E6_ets", "F4_metrics_by_class_model",
    "F12_interval_merge", "G4_daily_stats_by_route", "H6_business_kpis", "H9_item_window_stats", "I12_calibration", "J12_priority",
    "K9_peer_floor_rank", "K13_co_occurrence", "L2_merge_and_rank", "L5_explanations", "L7_van_allocation", "M5_smoothed_multipliers",
    "N6_adoption_highlights", "O6_redistribution", "P1_customer_history", "P9_scrubbed_codes", "Q2_live_unplanned_visits",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("VANFLOW_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_counts_classes(spark):
    assert entry.entry(spark).columns == ["class", "pairs"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, con, name):
    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem
