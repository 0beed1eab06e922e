from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import source, sources
from sourcegauge.operators import selection, views
from sourcegauge.operators.classify import classify
from sourcegauge.sources.thresholds import threshold_table


def by_id(df):
    return {r.sub_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def classified(spark):
    big = {"total_calls": 1000, "lead_volume": 1000, "leads_transferred": 90}
    rows = [
        source(0, "share .09", calls_over_threshold=140, call_revenue=9, lead_revenue=91, total_revenue=100, **big),
        source(1, "share .10", calls_over_threshold=140, call_revenue=10, lead_revenue=90, total_revenue=100, **big),
        source(2, "no revenue", calls_over_threshold=60, **big),
        source(3, "no calls", lead_volume=1000, leads_transferred=90, lead_revenue=5, total_revenue=5, media_type="Search"),
        source(4, "few calls", total_calls=49, lead_volume=1000, call_revenue=100, total_revenue=100, media_type="Social"),
        source(5, "premium held", internal_channel="Premium", calls_over_threshold=140, call_revenue=50, total_revenue=50, **big),
        source(6, "premium lost", internal_channel="Premium", calls_over_threshold=65, call_revenue=50, total_revenue=50, **big),
        source(7, "unknown pair", vertical="Pet", calls_over_threshold=500, call_revenue=50, total_revenue=50, **big),
    ]
    df = classify(sources(spark, rows)).persist()
    yield df
    df.unpersist()


def test_call_mode(classified):
    got = {k: (r.action, r.recommended_classification, r.classification_reason) for k, r in by_id(views.metric_mode(classified, "call")).items()}
    assert got["share .09"] == ("not_primary", "Standard", "Source primarily generates leads (91% of revenue). Not evaluated on call quality.")
    assert got["share .10"] == ("upgrade_to_premium", "Premium", "Call tier: Premium")
    assert got["no revenue"] == ("pause_immediate", "PAUSE", "Call tier: Pause")
    assert got["no calls"] == ("review", "Standard", "No data for selected metric")
    assert got["few calls"][0] == "insufficient_volume"
    assert got["premium held"] == ("keep_standard", "Standard", "Call tier: Premium")
    assert got["premium lost"] == ("demote_to_standard", "Standard", "Call tier: Standard")
    assert got["unknown pair"] == ("keep_standard", "Standard", "Call tier: Unknown")
    assert views.metric_mode(classified, "both") is classified


def test_counters_and_filters(classified):
    view = views.metric_mode(classified, "call")
    stats = views.view_stats(view).first().asDict()
    assert stats == {"promote": 1, "demote": 1, "below": 0, "correct": 3, "review": 1, "pause": 1, "insufficient_volume": 1}
    assert set(by_id(views.filtered(view, category="review"))) == {"share .09", "no calls"}
    assert set(by_id(views.filtered(view, vertical="Pet"))) == {"unknown pair"}
    assert views.filtered(view, category="keep_standard").count() == 2
    legacy = classified.withColumn("action", F.lit("promote"))
    assert views.view_stats(legacy).first().promote == 8


def test_status_and_remarks(classified):
    status = {k: (r.call_status, r.lead_status) for k, r in by_id(views.performance_status(classified)).items()}
    assert status["share .09"] == ("ON TARGET", "ON TARGET") and status["premium lost"][0] == "ATTENTION"
    assert status["no revenue"][0] == "BELOW MIN" and status["few calls"] == ("LOW VOL", "BELOW MIN")
    assert status["no calls"][0] == "LOW VOL" and status["unknown pair"] == ("N/A", "N/A")
    remarks = {k: r.remarks for k, r in by_id(views.quality_remarks(classified)).items()}
    assert remarks["few calls"] == ["Call volume (49) below minimum threshold of 50", "Low lead transfer at 0.0% needs review"]
    assert remarks["unknown pair"] == ["Strong call quality at 50.0%"]
    assert remarks["share .09"] == ["Insufficient data to assess quality metrics"]


def test_explanations(classified):
    got = by_id(views.explanation(classified))
    assert [tuple(d) for d in got["premium lost"].details] == [
        ("Call Quality", "6.5% (Standard)", "warning"), ("Lead Transfer", "9.0% (Premium)", "good")]
    odd = by_id(views.explanation(classified.withColumn("action", F.lit("other"))))
    assert odd["premium lost"].explanation == odd["premium lost"].classification_reason and odd["premium lost"].details == []
    call_only = by_id(views.explanation(views.metric_mode(classified, "call"), "call"))["share .09"]
    assert call_only.explanation.startswith("This source primarily generates leads (91% of revenue).")
    assert [tuple(d) for d in call_only.details] == [("Call Revenue", "$9 (9%)", "warning"), ("Lead Revenue", "$91 (91%)", "good"), ("Evaluation", "Not Evaluated", "neutral")]


def test_revenue_views(classified):
    mix = by_id(views.revenue_mix(classified))
    assert mix["no revenue"].call_share is None and mix["share .09"].lead_share == 91
    assert views.revenue_breakdown(classified).count() == 32
    context = by_id(views.revenue_context(classified))
    assert context["unknown pair"].vertical_share == 100
    assert sum(r.vertical_share for k, r in context.items() if k != "unknown pair") == pytest.approx(100)


def test_pages_and_positions(classified):
    order = ["share .09", "share .10", "few calls", "premium held", "premium lost", "unknown pair", "no calls", "no revenue"]
    assert [r.sub_id for r in views.page_of(classified, 1, 100).collect()] == order
    assert [r.sub_id for r in views.page_of(classified, 2, 3).collect()] == order[3:6]
    assert [r.sub_id for r in views.page_of(classified, 1, 2, None).collect()] == ["share .09", "share .10"]
    assert [r.sub_id for r in views.page_of(classified, 1, 2, "asc").collect()] == ["no revenue", "no calls"]
    found = by_id(views.locate(classified, ["no calls", "absent"], size=3))
    assert {k: (r.position, r.page) for k, r in found.items()} == {"no calls": (6, 3)}
    assert [r.media_type for r in views.distinct_values(classified, "media_type").collect()] == ["Search", "Social"]


def test_selection(spark):
    rows = [source(0, "dup", total_revenue=1, lead_volume=5), source(1, "dup", total_revenue=9, lead_volume=7, traffic_type="Non O&O"),
            source(2, "x", total_revenue=3), source(3, "y", vertical="Auto", total_revenue=2), source(4, "z", vertical="Auto", traffic_type="Non O&O", total_revenue=4)]
    view = classify(sources(spark, rows))
    none = selection.no_selection(view)
    assert selection.compare_total(view, none).count() == 0 and selection.compare_groups(view, none).count() == 0
    picked = spark.createDataFrame([("dup",), ("x",), ("gone",)], "sub_id STRING")
    groups = {(r.vertical, r.traffic_type): r for r in selection.compare_groups(view, picked).collect()}
    assert set(groups) == {("Health", "Non O&O"), ("Health", "Full O&O")}
    assert groups["Health", "Non O&O"].selected_lead_volume == 7 and groups["Health", "Full O&O"].total_count == 1
    total = selection.compare_total(view, picked).first()
    assert (total.selected_count, total.total_count, total.selected_revenue, total.total_revenue, total.verticals, total.revenue_pct) == (2, 2, 12, 12, ["Health"], 100)
    toggled = selection.toggle(picked, spark.createDataFrame([("x",), ("x",), ("y",)], "sub_id STRING"))
    assert sorted(r.sub_id for r in toggled.collect()) == ["dup", "gone", "y"]
    everything = selection.select_visible(picked, view)
    assert everything.count() == 5 and selection.selected_rows(view, everything).count() == 5
    assert selection.select_category(none, view, "insufficient_volume").count() == 4


def test_threshold_rows(spark):
    assert threshold_table(spark).count() == 15
    assert {f.dataType.simpleString() for f in threshold_table(spark).schema if f.name.endswith("_min")} == {"double"}
