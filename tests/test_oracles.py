"""Registered queries against their SQL in DuckDB at sf0.001.

The default run takes one query per area; ``ATTESTRY_ALL=1`` runs them all.
"""

import os

import pytest

import __spark_entry__ as entry
from attestry_queries import harness

SF = "/root/testdata/sf0.001"
SOME = ["s1_object_event_scan", "p7_actor_whitelist_exact", "j1_issuance_earliest", "w5_issuance_asof", "reconcile_violations", "a3_categories",
        "f26_ticket_body", "f2_normalize_time", "f50_curated_payload", "s7_decode_deliveries", "s8_parse_submissions", "a9_control_inventory",
        "j15_upload_links", "j9_merge_evidence", "f38_skeletons", "q4_control_ids", "j10_gap_analysis", "t5_alarms", "f45_sla", "f48_skip_unchanged",
        "f49_sensitive_scan", "t3_stream_dedup", "j3_disjoint_windows", "j3_endless_windows", "t1_first_copies", "t5_whole_alarms",
        "s17_sink_counts", "a11_stream_counts", "s18_whole_header", "s5_pruned_store", "f48_incremental", "l1_event_order", "l2_group_order",
        "l5_control_order", "a12_rollup", "s9_data_source", "s9_failed_listings", "reconcile_raw_tables"]
NAMES = sorted(entry.queries()) if os.environ.get("ATTESTRY_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = harness.check(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_registry():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(queries) > 100


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["ord", "local_date", "type"]
