"""Shape of physical plans: what must and must not be in them."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sourcegauge.operators import portfolio, scenarios, selection, signals, views
from sourcegauge.operators.classify import classify
from sourcegauge.operators.report import direct_metrics, outbound_transfers, performance_report, session_calls
from sourcegauge.operators.rollup import rollup
from sourcegauge.plans.pipelines import Analysis
from sourcegauge.plans.registered import REGISTERED, _classified, _rows
from sourcegauge.session import freeze
from sourcegauge.sources.star import StarTables

FORBIDDEN = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def analysis(spark, tables):
    return Analysis(_classified(spark, tables))


def test_no_python_and_no_cross_join(spark, tables, analysis):
    view = _classified(spark, tables)
    picked = selection.select_category(selection.no_selection(view), view, "below")
    frames = {
        "report": REGISTERED["report_full"](spark, tables), "classified": view, "rollup": rollup(_rows(spark, tables), "placement"),
        "sources": analysis.sources, "cohorts": portfolio.cohort_intelligence(analysis.insights), "health": portfolio.portfolio_health(analysis.insights),
        "scenarios": scenarios.what_if_scenarios(analysis.insights), "members": scenarios.scenario_members(analysis.insights),
        "alerts": scenarios.smart_alerts(analysis.insights, analysis.cohorts, analysis.health), "overall": analysis.overall(),
        "alert members": scenarios.alert_members(analysis.insights, analysis.cohorts, analysis.health), "facts": analysis.executive_facts(),
        "compared": selection.compare_total(view, picked), "shares": views.revenue_context(view),
    }
    for name, df in frames.items():
        text = plan(df)
        assert not [w for w in FORBIDDEN if w in text], name


def test_window_only_over_bounded_rows(spark, tables, analysis):
    """Windows without a partition run over one row per slice, never over sources."""
    text = plan(views.locate(_classified(spark, tables), ["SUB00001"]))
    single = [line for line in text.splitlines() if re.search(r"\bWindow \[", line) and "slice" not in line]
    assert not single
    assert "Window" not in plan(analysis.sources)


def test_sources_are_not_shuffled_for_cohort_columns(spark, tables):
    insights = signals.Insights(_classified(spark, tables))
    text = plan(insights.sources.drop("opportunity_type"))
    body = text.split("Subquery")[0]
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in body


def test_classify_is_one_narrow_pass(spark, tables):
    rows = freeze(_rows(spark, tables), "rows")
    text = plan(classify(rows))
    assert "Exchange hashpartitioning" not in text and text.count("FileScan") == 1 and "BroadcastHashJoin" in text


def test_large_cohort_table_is_not_broadcast(spark, tables):
    """Beyond the size limit the cohort join becomes a shuffle join with the same result."""
    small = signals.Insights(_classified(spark, tables)).sources.select("sub_id", "overall_percentile", "call_z").collect()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = signals.Insights(_classified(spark, tables)).sources.select("sub_id", "overall_percentile", "call_z")
        assert "SortMergeJoin" in plan(df)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_facts_are_pruned_and_filtered_at_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "facts")
    year = F.col("date_platform").between(dt.date(1998, 5, 1), dt.date(1998, 8, 1))
    StarTables(spark, tables).facts().where(year).coalesce(1).write.partitionBy("date_platform").parquet(path)
    facts = spark.read.parquet(path)
    report = performance_report(facts, StarTables(spark, tables).dimension(), dt.date(1998, 6, 1), dt.date(1998, 7, 1))
    text = plan(report)
    scans = [line for line in text.splitlines() if "FileScan" in line and "date_platform" in line]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(date_platform" in s for s in scans)
    lead_scan = next(s for s in scans if "EqualTo(transaction_type,Lead)" in s)
    assert "placement" not in lead_scan and "revenue" not in lead_scan
    calls = plan(session_calls(facts))
    assert "EqualTo(call_category,Outbound)" in calls and "placement" not in calls


def test_facts_are_summed_in_hash_maps(spark, tables):
    """Only the few rows per (source, placement, channel) are sorted, not the facts."""
    text = plan(direct_metrics(StarTables(spark, tables).facts()))
    lowest = [line for line in text.splitlines() if "partial_sum" in line][-1]
    assert "HashAggregate" in lowest and "SortAggregate" not in lowest
    assert "SortAggregate" not in plan(outbound_transfers(StarTables(spark, tables).link_facts()))


def test_hot_session_is_split(spark):
    """A session that owns a third of the leads is divided among tasks."""
    rows = spark.range(600000).select(
        F.concat(F.lit("S"), F.col("id") % 100).alias("sub_id"), F.lit("Health").alias("vertical"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("session_id"),
        F.when(F.col("id") % 10 == 1, "Call").otherwise("Lead").alias("transaction_type"), F.lit("Outbound").alias("call_category"),
        F.lit(1).alias("call_transfers"), F.lit(1).alias("paid_calls"), F.lit(1500.0).alias("call_duration"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    old = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        total = outbound_transfers(rows).agg(F.sum("credited").alias("n"))
        calls_of_hot = rows.where("session_id = 0 AND transaction_type = 'Call'").count()
        leads_of_hot = rows.where("session_id = 0 AND transaction_type = 'Lead'").count()
        assert total.first().n == calls_of_hot * leads_of_hot > 0
        total.collect()
        assert "SortMergeJoin(skew=true)" in plan(total)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_few_rows_per_cohort_are_kept_before_the_shuffle(spark, tables, analysis):
    text = plan(scenarios.alert_members(analysis.insights, analysis.cohorts, analysis.health, sample=5))
    assert "WindowGroupLimit" in text


def test_top_k_is_not_a_global_sort(spark, tables, analysis):
    assert "TakeOrderedAndProject" in plan(views.priority_list(analysis.sources, "remediate", 3))
    assert "TakeOrderedAndProject" in plan(views.page_of(_classified(spark, tables).drop("call_cls", "lead_cls"), 2, 10))


def test_frozen_tables_live_in_the_shared_folder(spark):
    df = freeze(spark.range(5).select(F.col("id")), "x")
    assert df.inputFiles()[0].replace("file://", "").startswith(spark.conf.get("spark.checkpoint.dir"))
