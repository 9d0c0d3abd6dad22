"""Spark queries against their DuckDB twins on sf0.001.

A representative query per family runs by default; set PAYSIFT_FULL_ORACLE=1
to compare every registered query that has an oracle."""

import os

import pytest

import __spark_entry__ as E

from .compare import assert_same, duck

DEFAULT = [
    "f02_kpi_by_period", "f03_kpi_by_category", "f10_kpi_star", "f13_kpi_employee_date", "f14_canonical_lines",
    "f23_turnover", "f33_new_hire_stats", "f35_kpi_with_delta", "f43_compare_periods_code", "f45_anomaly_set",
    "f61_rollup_series", "b01_amount_to_cents", "b02_parse_pay_date", "b21_pseudonymise", "d01_validate_lines",
    "d14_overlaps", "e07_load_fact", "e08_dedup_report", "c06_cardinality_profile", "i01_ledger_page",
    "a13_row_numbers", "l01_chunk_documents", "l03_cosine_topk", "m02_stream_dedup",
    "f18_by_function", "f44_period_stats", "f56_equity", "m03_stream_kpi_month",
    "a09_ledger_store", "a12_snapshot_documents", "c11_propose_mapping", "c12_propose_mapping_value_first", "d10_stored_orphans",
    "e12_stored_incremental", "f48_report_accented_pivot", "i01_seek_pages", "i03_indexed_search", "l03_cosine_topk_many",
    "m01_stream_fact", "m04_refresh_kpi_star",
]
NAMES = sorted(E.oracle_sql()) if os.environ.get("PAYSIFT_FULL_ORACLE") else DEFAULT


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, con, name):
    assert name in E.oracle_sql(), name
    assert_same(E.queries()[name](spark, sf), con, E.oracle_sql()[name])
