"""Registered queries against their SQL on the smallest tables. ALL_QUERIES=1 runs every query."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from checks.compare import compare, database
from checks.oracle import oracle_queries
from sourcegauge.plans.registered import REGISTERED

SOME = ("report_full", "report_outbound_link", "csv_upload", "classify_reasons", "rollup_metadata", "explanation", "selection_compare_groups", "locate_page",
        "source_profile", "opportunity_matrix", "cohort_intelligence", "overall_insights", "history_search", "threshold_overrides", "export_view")


@pytest.fixture(scope="module")
def con(tables):
    return database(tables)


@pytest.mark.parametrize("name", REGISTERED if os.environ.get("ALL_QUERIES") else SOME)
def test_same_rows(spark, con, tables, name):
    assert compare(spark, con, tables, name, oracle_queries()[name]) == []


def test_every_query_has_sql():
    assert set(REGISTERED) == set(oracle_queries()) and set(REGISTERED) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["vertical", "traffic_type", "action", "recommended_classification", "sources", "revenue"]
    assert sum(r.sources for r in rows.collect()) == 10
