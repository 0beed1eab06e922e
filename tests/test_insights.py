from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from helpers import record, records
from sourcegauge.operators import portfolio, scenarios
from sourcegauge.operators.classify import classify
from sourcegauge.operators.signals import Insights, cluster_members, cluster_summary, source_profile, with_clusters, with_risk
from sourcegauge.plans.pipelines import Analysis
from test_classify import golden_sources


def by_id(df):
    return {r.sub_id: r for r in df.collect()}


def test_golden_portfolio(spark):
    a = Analysis(classify(golden_sources(spark)))
    assert all(r.risk_score == 0 and r.risk_confidence == 100 for r in a.sources.collect())
    h = a.health.first()
    assert (h.revenue_at_risk, h.diversification_score, h.top5_revenue_share, h.top10_revenue_share) == (0, 87, 72, 100)
    assert (h.single_source_dependency, h.premium_count, h.standard_count, h.trend_indicator, h.overall_health_score) == (False, 4, 6, "improving", 100)
    o = a.overall().first()
    assert o.portfolio_grade == "A" and o.quality_trend == "improving" and o.source_count == 10
    facts = a.executive_facts().first()
    assert (facts.total_sources, facts.total_revenue, facts.filter_context) == (10, 688355, "All Data")
    assert [c.label for c in facts.cluster_summary] == ["⭐ Elite Performers", "📈 Promotion Ready", "⚖️ Stable Standard"]
    assert source_profile(a.insights).count() == 10


def test_risk_points(spark):
    rows = [record(1, tier="Premium", action="demote_with_warning", call=0.2, lead=0.05),
            record(2, action="pause_immediate", call=0.3, lead=0.1, calls=20),
            record(3, action="insufficient_volume", call=None, lead=None, low=True, calls=3.5, leads=0),
            record(4, action="brand_new", call=0.9, lead=0.9),
            record(5, tier="Premium", action="keep_premium_watch", call=0.25, lead=0.15)]
    got = by_id(with_risk(records(spark, rows)))
    assert got["S0001"].risk_score == 35 + 15 + 15 + 10 and got["S0001"].risk_level == "critical"
    assert got["S0001"].risk_factors == ["Premium demoted with 14-day warning", "Premium source losing status",
                                         "Call quality critical (20.0%)", "Lead transfer critical (5.0%)"]
    assert got["S0002"].risk_score == 40 + 5 + 8 + 5 and got["S0002"].risk_level == "high"
    assert (got["S0003"].risk_score, got["S0003"].risk_confidence) == (20, 30)
    assert "Low volume (3.5 calls, 0 leads)" in got["S0003"].risk_factors
    assert (got["S0004"].risk_score, got["S0004"].risk_factors) == (5, ["Unknown action"])
    assert got["S0005"].risk_score == 15 + 5 + 8 and got["S0005"].risk_level == "medium"


def test_clusters(spark):
    pairs = [("Premium", "keep_premium", 0), ("Standard", "upgrade_to_premium", 1), ("Standard", "keep_standard_close", 2), ("Premium", "keep_premium_watch", 3),
             ("Premium", "demote_with_warning", 4), ("Standard", "insufficient_volume", 5), ("Premium", "keep_standard", 6), (None, "correct", 2),
             ("Standard", "keep_premium", 6), ("Premium", "no_premium_available", 6)]
    df = with_clusters(records(spark, [record(i, tier=t, action=a, call=None if i == 0 else 0.2) for i, (t, a, _) in enumerate(pairs)]))
    got = by_id(df)
    assert [got[f"S{i:04d}"].cluster for i in range(len(pairs))] == [c for *_, c in pairs]
    assert math.isclose(got["S0000"].composite_score, 25 + 3)
    assert cluster_summary(df).where("cluster_id = 0").first().avg_call_quality is None
    assert [r.sub_id for r in cluster_members(df, 6).collect()] == ["S0006", "S0008", "S0009"]


def test_anomaly_needs_six_peers_and_negative_wins(spark):
    six = [record(i, call=0.1, lead=0.2, revenue=100) for i in range(5)] + [record(5, call=0.9, lead=0.01, revenue=100)]
    pair = [record(i, vertical="Auto", call=0.1 * i, revenue=i) for i in (10, 11)]
    tier = [record(20, vertical="Home", tier="Premium", action="demote_to_standard"), record(21, vertical="Home", action="upgrade_to_premium")]
    got = by_id(Insights(records(spark, six + pair + tier)).sources)
    odd = got["S0005"]
    assert odd.is_anomaly and odd.anomaly_type == "negative" and odd.revenue_z == 0
    assert odd.anomaly_reasons == ["Call quality 2.2σ above Health Full O&O peers", "Lead transfer 2.2σ below peers"]
    assert got["S0010"].call_z is None and got["S0010"].anomaly_type == "none"
    assert got["S0020"].anomaly_type == "negative" and got["S0021"].anomaly_type == "positive"
    assert got["S0020"].anomaly_reasons == ["Premium source recommended for demotion - quality dropped"]


@pytest.mark.parametrize("partitions", [1, 2, 3, 5])
def test_score_of_exactly_two_is_no_flag(spark, partitions):
    rows = [record(i, call=0.0, lead=0.3) for i in range(4)] + [record(4, call=0.07661290322580645, lead=0.3)]
    got = by_id(Insights(records(spark, rows).repartition(partitions)).sources)
    assert got["S0004"].call_z == 2.0 and not got["S0004"].is_anomaly


def test_multipliers(spark):
    def cohort(vertical, premium, other):
        rows = [record(0, vertical=vertical, tier="Premium", revenue=r, action="upgrade_to_premium") for r in premium]
        return rows + [record(0, vertical=vertical, revenue=r, action="upgrade_to_premium") for r in other]

    cases = {"a": ([300, 500], [100, 200]), "b": ([300], [100, 200]), "c": ([0], [0]), "d": ([10], [0]), "e": ([], [5]), "f": ([50, 50], [100, 100])}
    rows = [r for v, (p, o) in cases.items() for r in cohort(v, p, o)]
    rows = [(i, f"S{i:04d}", *r[2:]) for i, r in enumerate(rows)]
    got = {r.vertical: (r.impact_multiplier, r.opportunity_multiplier) for r in Insights(records(spark, rows)).sources.collect()}
    assert got == {"a": (2.5, 2.0), "b": (1.0, 2.0), "c": (1.0, 1.15), "d": (1.0, 2.0), "e": (1.0, 1.15), "f": (1.0, 1.0)}


def test_zero_percentile_counts_as_missing(spark):
    rows = [record(i, call=0.5 + i / 100, lead=0.5 + i / 100, revenue=i) for i in range(1, 4)]
    got = by_id(Insights(records(spark, rows)).sources)
    assert got["S0001"].overall_percentile == 0
    assert got["S0001"].performance_index == round(50 * 0.6 + 100 * 0.4)


def mixed(n=60):
    actions = ["upgrade_to_premium", "pause_immediate", "warning_14_day", "keep_standard_close", "keep_premium_watch", "demote_with_warning",
               "no_premium_available", "insufficient_volume", "keep_premium"]
    return [record(i, vertical=["Health", "Auto"][i % 2], traffic_type=["Full O&O", "Non O&O"][i % 3 % 2], tier=["Premium", "Standard"][i % 2],
                   action=actions[i % 9], call=None if i % 10 == 0 else (i % 7) / 20, lead=(i % 5) / 50, revenue=5000 if i == 33 else i * 3 % 17,
                   low=i % 9 == 7) for i in range(n)]


def test_members_match_summaries(spark):
    a = Analysis(records(spark, mixed()))
    assert a.health.first().single_source_dependency
    per_scenario = {r.scenario_no: r["count"] for r in scenarios.scenario_members(a.insights).groupBy("scenario_no").count().collect()}
    assert per_scenario == {r.scenario_no: r.affected_count for r in a.scenarios.collect()}
    per_rule = {r.rule: r["count"] for r in scenarios.alert_members(a.insights, a.cohorts, a.health).groupBy("rule").count().collect()}
    alerts = scenarios.sorted_alerts(a.alerts).collect()
    assert per_rule == {r.rule: r.affected_count for r in alerts}
    assert [r.severity_rank for r in alerts] == sorted(r.severity_rank for r in alerts) and 4 in per_rule
    ids = [r.alert_id for r in sorted(alerts, key=lambda r: r.rule)]
    assert ids == [f"alert_{i + 1}" for i in range(len(ids))]


def test_results_do_not_depend_on_partitioning(spark):
    def everything(df):
        a = Analysis(df)
        wide = sorted(map(str, a.sources.select("sub_id", "cluster", "risk_score", "overall_percentile", "anomaly_type", "priority_score").collect()))
        return wide, str(a.health.first()), sorted(map(str, portfolio.top_performers(a.insights.base).select("sub_id", "position").collect()))

    assert everything(records(spark, mixed()).repartition(1)) == everything(records(spark, mixed()).repartition(9, "sub_id"))


def test_ranges(spark):
    rows = Insights(records(spark, mixed())).sources.collect()
    for r in rows:
        assert 0 <= r.risk_score <= 100 and 0 <= r.overall_percentile <= 100 and 0 <= r.impact_score <= 100
        assert r.call_percentile is None or 0 <= r.call_percentile <= 100


def test_scope_and_empty_input(spark):
    df = records(spark, [record(1, media="Search"), record(2, media="Social")])
    assert [r.sub_id for r in Analysis(df, media_type="Social").sources.collect()] == ["S0002"]
    empty = Analysis(df, vertical="Nowhere")
    o = empty.overall().first()
    assert (o.source_count, o.portfolio_grade, o.quality_trend, o.top_performers, o.total_potential_gain) == (0, "F", "stable", [], 0)
    h = empty.health.first()
    assert (h.overall_health_score, h.diversification_score, h.single_source_dependency, h.trend_indicator) == (0, 0, False, "stable")
    assert empty.scenarios.count() == 0 and empty.alerts.count() == 0 and empty.cohorts.count() == 0
    assert empty.executive_facts().first().filter_context == "Vertical: Nowhere"


@pytest.mark.parametrize("n,wanted", [(2, 2), (14, 3), (25, 5)])
def test_top_performers(spark, n, wanted):
    df = records(spark, [record(i, revenue=i // 2) for i in range(n)])
    best = portfolio.top_performers(df).orderBy("position").collect()
    assert [r.ord for r in best] == sorted(range(n), key=lambda i: (-(i // 2), i))[:wanted]
    assert portfolio.sorted_cohorts(df.groupBy(F.col("vertical").alias("cohort_name")).agg(F.sum("total_revenue").alias("total_revenue"))).count() == 1


@pytest.mark.parametrize("revenues", [[5] * 40, [9, 9, 9, 9, 1, 1], [None, 3, None], [0.0] * 3 + [7] * 30 + [8]])
def test_top_share_at_ties(spark, revenues):
    """Sources that share the revenue at the cut are taken in input order, whatever their number."""
    df = records(spark, [record(i, revenue=0) for i in range(len(revenues))])
    given = spark.createDataFrame(list(enumerate(map(lambda r: None if r is None else float(r), revenues))), "o long, r double")
    df = df.join(given, df.ord == given.o).withColumn("total_revenue", F.col("r")).drop("o", "r")
    wanted = sorted(range(len(revenues)), key=lambda i: (revenues[i] is None, -(revenues[i] or 0), i))[: max(3, len(revenues) // 5)]
    assert sorted(r.ord for r in portfolio.top_share(df).collect()) == sorted(wanted)
    assert [r.ord for r in portfolio.top_performers(df).orderBy("position").collect()] == wanted
