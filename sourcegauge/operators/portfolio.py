"""Cohort intelligence, portfolio health and the one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import one_of, texts
from ..functions.numbers import fixed_text, round_half_up
from ..schema import COHORT, ORD
from ..session import freeze
from ..settings import PAUSE, PROMOTE, WARN
from .cohorts import premium
from .ordering import cumulate, positions
from .signals import Insights, cluster_summary

# Action lists of the portfolio figures.
AT_RISK = (*PAUSE, *WARN, "demote_with_warning")
SHORT_TERM = (*WARN, "demote_to_standard", "demote_with_warning")
MONITOR = ("keep_premium_watch", "keep_standard_close")
NO_ACTION = ("keep_premium", "keep_standard", *PROMOTE, "correct", "not_primary")
POSITIVE = (*PROMOTE, "keep_premium")
NEGATIVE = (*PAUSE, "demote_to_standard", "demote_with_warning", "warning_14_day")
GRADES = ((85, "A"), (70, "B"), (55, "C"), (40, "D"))


def _acts(actions: tuple[str, ...]) -> Column:
    return one_of(F.col("action"), actions)


def _revenue_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("total_revenue")).otherwise(F.lit(0.0)))


def _share(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 where the whole is not positive."""
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0).cast("bigint"))


def _trend(up: Column, down: Column) -> Column:
    return F.when(up > down * 1.5, "improving").when(down > up * 1.5, "declining").otherwise("stable")


# ---- cohorts ----------------------------------------------------------------------------

def top_share(sources: DataFrame) -> DataFrame:
    """The first max(3, 20 %) sources of each cohort by revenue, without their order.

    Only distinct revenues with their counts are ordered. They give the revenue at which a cohort's cut falls; sources above it are in,
    and of those that share it, where not all fit, the first in input order: these alone are ranked.
    """
    keys = list(COHORT)
    values = sources.groupBy(*keys, "total_revenue").agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulate(values, keys, [F.col("total_revenue").desc_nulls_last()], ["n"])
    wanted = F.least(F.greatest(F.lit(3), F.floor(F.col("whole_n") * 0.2)), F.col("whole_n"))
    cut = ranked.where((F.col("before_n") < wanted) & (wanted <= F.col("before_n") + F.col("n"))).select(
        *keys, F.col("total_revenue").alias("cut"), (wanted - F.col("before_n")).alias("places"), F.col("n").alias("sharing"))
    narrow = sources.select(ORD, "sub_id", *keys, "total_revenue", "call_quality_rate", "lead_transfer_rate", "current_classification")
    placed = narrow.join(freeze(cut, "cuts"), keys)
    at_cut = F.col("total_revenue").eqNullSafe(F.col("cut"))
    above = (F.col("total_revenue") > F.col("cut")) | (F.col("cut").isNull() & F.col("total_revenue").isNotNull())
    fits = F.col("places") == F.col("sharing")
    tied = positions(placed.where(at_cut & ~fits), keys, [F.col(ORD)]).where("position < places")
    return placed.where(above | (at_cut & fits)).select(*narrow.columns).unionByName(tied.select(*narrow.columns))


def top_performers(sources: DataFrame) -> DataFrame:
    """``top_share`` with each source's zero-based position in its cohort."""
    ranked = positions(top_share(sources), COHORT, [F.col("total_revenue").desc_nulls_last(), F.col(ORD).asc()])
    return ranked.drop("group_size")


def cohort_intelligence(insights: Insights) -> DataFrame:
    """Benchmarks, traits, issues and health of each cohort. Unsorted; one row per cohort."""
    best = top_share(insights.base).groupBy(*COHORT).agg(
        F.count("*").alias("top_n"),
        F.count_if(premium()).alias("top_premium"),
        F.avg("call_quality_rate").alias("top_call"),
        F.avg("lead_transfer_rate").alias("top_lead"),
    )
    risky = insights.scored.groupBy(*COHORT).agg(
        F.avg("risk_score").alias("avg_risk"),
        F.count_if(_acts(PAUSE)).alias("pauses"),
        F.count_if(_acts(WARN)).alias("warnings"),
        F.count_if("has_insufficient_volume").alias("low_volume"),
        F.count_if(_acts(PROMOTE)).alias("candidates"),
        _revenue_where(_acts((*PAUSE, *WARN))).alias("risk_revenue"),
    )
    portfolio = insights.base.select(F.struct(
        F.avg("call_quality_rate").alias("call"),
        F.avg("lead_transfer_rate").alias("lead"),
        F.avg("total_revenue").alias("revenue"),
        F.sum("total_revenue").alias("total"),
    ).alias("p"))
    profile = insights.cohorts.drop("steps_call", "steps_lead", "steps_revenue")
    rows = profile.join(risky, list(COHORT)).join(best, list(COHORT)).withColumn("p", portfolio.scalar())
    n, call, lead = F.col("peers"), F.col("call_mean"), F.col("lead_mean")

    def trait(top: str, own: Column, name: str) -> Column:
        base = F.coalesce(own, F.lit(0.0))
        gap = fixed_text((F.col(top) - base) * 100, 0)
        return F.when(F.col(top) > base * 1.1, F.concat(gap, F.lit(f"pp higher {name} than cohort avg")))

    def issue(own: Column, whole: str, name: str) -> Column:
        whole = F.col(f"p.{whole}")
        return F.when(own < whole * 0.9, F.concat(F.lit(f"{name} quality "), fixed_text((whole - own) * 100, 1), F.lit("pp below portfolio avg")))

    def number(c: str) -> Column:
        return F.col(c).cast("string")

    traits = texts(
        trait("top_call", call, "call quality"),
        trait("top_lead", lead, "lead transfer"),
        F.when(F.col("top_premium") > 0, F.concat(number("top_premium"), F.lit("/"), number("top_n"), F.lit(" top performers are Premium tier"))),
    )
    issues = texts(
        F.when(F.col("pauses") > 0, F.concat(number("pauses"), F.lit(" sources ("), fixed_text(F.col("pauses") / n * 100, 0), F.lit("%) flagged for PAUSE"))),
        F.when(F.col("warnings") > 0, F.concat(number("warnings"), F.lit(" sources with 14-day warnings"))),
        F.when(F.col("low_volume") > n * 0.3, F.concat(F.lit("High low-volume rate: "), fixed_text(F.col("low_volume") / n * 100, 0), F.lit("%"))),
        issue(call, "call", "Call"),
        issue(lead, "lead", "Lead"),
    )

    def or_note(items: Column, note: str) -> Column:
        return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(note)))

    revenue = F.col("cohort_revenue")
    return rows.select(
        *COHORT,
        F.concat("vertical", F.lit(" - "), "traffic_type").alias("cohort_name"),
        n.alias("source_count"),
        revenue.alias("total_revenue"),
        F.when(F.col("p.total") > 0, revenue / F.col("p.total") * 100).otherwise(F.lit(0.0)).alias("revenue_share"),
        call.alias("avg_call_quality"),
        lead.alias("avg_lead_quality"),
        or_note(traits, "Insufficient data to identify patterns").alias("top_performer_traits"),
        or_note(issues, "No significant issues detected").alias("common_issues"),
        _share(F.col("candidates"), F.col("other_peers")).alias("optimization_potential"),
        (call - F.col("p.call")).alias("call_quality_delta"),
        (lead - F.col("p.lead")).alias("lead_quality_delta"),
        (F.col("revenue_mean") - F.col("p.revenue")).alias("revenue_delta"),
        round_half_up(100 - F.col("avg_risk")).alias("health_score"),
        _share(F.col("risk_revenue"), revenue).alias("risk_concentration"),
    )


def cohort_order() -> list[Column]:
    return [F.col("total_revenue").desc(), F.col("cohort_name")]


def sorted_cohorts(cohorts: DataFrame) -> DataFrame:
    return cohorts.orderBy(*cohort_order())


# ---- portfolio --------------------------------------------------------------------------

def largest_revenues(sources: DataFrame, k: int = 10) -> DataFrame:
    """One row: the k largest revenues, descending."""
    top = sources.select("total_revenue").orderBy(F.col("total_revenue").desc_nulls_last()).limit(k)
    return top.select(F.sort_array(F.collect_list("total_revenue"), asc=False).alias("revenues"))


def portfolio_health(insights: Insights) -> DataFrame:
    """One row with risk, concentration, distribution, action summary, trend and health."""
    total = F.coalesce(insights.base.select(F.sum("total_revenue")).scalar(), F.lit(0.0))
    share = F.when(total > 0, F.col("total_revenue") / total).otherwise(F.lit(0.0))
    counted = insights.scored.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("total_revenue"), F.lit(0.0)).alias("total"),
        F.coalesce(_revenue_where(_acts(AT_RISK)), F.lit(0.0)).alias("revenue_at_risk"),
        F.coalesce(F.sum(share * share), F.lit(0.0)).alias("hhi"),
        F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("avg_risk"),
        F.count_if(premium()).alias("premium_count"),
        F.count_if(F.coalesce(F.col("current_classification"), F.lit("")).isin("Standard", "")).alias("standard_all"),
        F.count_if(_acts((*WARN, "demote_with_warning"))).alias("at_risk_count"),
        F.count_if(_acts(PAUSE)).alias("paused_count"),
        F.count_if(_acts(SHORT_TERM)).alias("short_term_actions"),
        F.count_if(_acts(MONITOR)).alias("monitoring_required"),
        F.count_if(_acts(NO_ACTION)).alias("no_action_needed"),
        F.count_if(_acts(POSITIVE)).alias("positive"),
        F.count_if(_acts(NEGATIVE)).alias("negative"),
    ).withColumn("top", largest_revenues(insights.base).scalar())

    def top_sum(k: int) -> Column:
        return F.aggregate(F.slice("top", 1, k), F.lit(0.0), lambda acc, x: acc + x)

    some = F.col("n") > 0
    diversification = F.when(some, round_half_up((1 - F.col("hhi")) * 100)).otherwise(F.lit(0).cast("bigint"))
    health = (
        100 - F.col("avg_risk") * 0.5 + F.try_divide("premium_count", "n") * 20
        - F.try_divide(F.col("paused_count") + F.col("at_risk_count"), F.col("n")) * 30
        + F.col("diversification_score") * 0.1
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), health))
    return counted.withColumn("diversification_score", diversification).select(
        F.when(some, round_half_up(clamped)).otherwise(F.lit(0).cast("bigint")).alias("overall_health_score"),
        "revenue_at_risk",
        _share(F.col("revenue_at_risk"), F.col("total")).alias("revenue_at_risk_percent"),
        "diversification_score",
        "premium_count",
        (F.col("standard_all") - F.col("at_risk_count") - F.col("paused_count")).alias("standard_count"),
        "at_risk_count",
        "paused_count",
        _share(top_sum(5), F.col("total")).alias("top5_revenue_share"),
        _share(top_sum(10), F.col("total")).alias("top10_revenue_share"),
        F.coalesce(F.try_element_at("top", F.lit(1)) > F.col("total") * 0.25, F.lit(False)).alias("single_source_dependency"),
        F.col("paused_count").alias("immediate_actions"),
        "short_term_actions",
        "monitoring_required",
        "no_action_needed",
        _trend(F.col("positive"), F.col("negative")).alias("trend_indicator"),
    )


# ---- overall ----------------------------------------------------------------------------

def top_sources(sources: DataFrame, k: int = 5) -> DataFrame:
    """The best sources from the 80th percentile on."""
    return sources.where(F.col("overall_percentile") >= 80).orderBy(F.col("overall_percentile").desc(), ORD).limit(k)


def at_risk_sources(sources: DataFrame, k: int = 5) -> DataFrame:
    return sources.where(one_of(F.col("risk_level"), ("critical", "high"))).orderBy(F.col("risk_score").desc(), ORD).limit(k)


def _ids(listed: DataFrame, score: str) -> Column:
    """Ids of a short list, in its order, as a one-row scalar."""
    entries = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(ORD).alias("o"), F.col("sub_id").alias("id"))))
    return listed.select(F.transform(entries, lambda e: e["id"])).scalar()


def overall_insights(insights: Insights, scenarios: DataFrame, alerts: DataFrame, health: DataFrame) -> DataFrame:
    """One row: counts, totals, grade, trend and the value of acting."""
    sources = insights.sources
    gain = F.coalesce(F.sum("potential_gain"), F.lit(0.0))
    value = F.when(F.col("potential_revenue") > 0, F.col("potential_revenue") * (F.col("opportunity_confidence") / 100)).otherwise(F.lit(0.0))
    urgent = (F.col("priority_score") > 1.5) | (F.col("timeframe") == "immediate")
    counted = sources.agg(
        F.count("*").alias("n"),
        F.count_if("is_anomaly").alias("total_anomalies"),
        F.count_if(F.col("anomaly_type") == "positive").alias("positive_anomalies"),
        F.count_if(F.col("anomaly_type") == "negative").alias("negative_anomalies"),
        F.count_if(one_of(F.col("risk_level"), ("critical", "high"))).alias("high_risk_count"),
        gain.alias("total_potential_gain"),
        F.coalesce(F.sum("potential_loss"), F.lit(0.0)).alias("total_potential_loss"),
        F.count_if(F.col("trajectory") == "improving").alias("improving"),
        F.count_if(F.col("trajectory") == "declining").alias("declining"),
        F.coalesce(round_half_up(F.avg("performance_index")), F.lit(0).cast("bigint")).alias("revenue_efficiency_score"),
        F.count_if(urgent).alias("urgent"),
        F.coalesce(round_half_up(F.sum(value)), F.lit(0).cast("bigint")).alias("estimated_optimization_value"),
    )
    promote_change = scenarios.where(F.col("scenario_no") == 1).select(F.coalesce(F.sum("revenue_change"), F.lit(0.0))).scalar()
    loud = alerts.where(one_of(F.col("severity"), ("critical", "opportunity"))).select(F.count("*")).scalar()
    score = health.select("overall_health_score").scalar()
    grade = F.lit("F")
    for least, letter in reversed(GRADES):
        grade = F.when(F.col("health") >= least, letter).otherwise(grade)
    return counted.withColumn("health", score).select(
        F.col("n").alias("source_count"),
        "total_anomalies", "positive_anomalies", "negative_anomalies", "high_risk_count", "total_potential_gain",
        "total_potential_loss",
        _ids(top_sources(sources), "overall_percentile").alias("top_performers"),
        _ids(at_risk_sources(sources), "risk_score").alias("at_risk_performers"),
        (F.col("total_potential_gain") + promote_change).alias("optimization_opportunity"),
        F.when(F.col("n") > 0, grade).otherwise("F").alias("portfolio_grade"),
        _trend(F.col("improving"), F.col("declining")).alias("quality_trend"),
        "revenue_efficiency_score",
        (F.col("urgent") + loud).alias("actionable_insights_count"),
        "estimated_optimization_value",
    )


def executive_facts(insights: Insights, overall: DataFrame, health: DataFrame, filter_context: str = "All Data") -> DataFrame:
    """One-row fact sheet: counts, revenue, clusters and short lists."""
    row = overall.select(F.struct("*")).scalar()
    risk = health.select("revenue_at_risk").scalar()
    cluster = F.struct("cluster_id", "label", F.col("sources").alias("count"), "avg_revenue")
    clusters = cluster_summary(insights.sources).select(F.sort_array(F.collect_list(cluster))).scalar()
    return insights.base.agg(
        F.count("*").alias("total_sources"),
        F.count_if(premium()).alias("premium_count"),
        F.count_if(F.col("current_classification") == "Standard").alias("standard_count"),
        F.count_if(F.col("action") == "pause_immediate").alias("pause_count"),
        F.coalesce(F.sum("total_revenue"), F.lit(0.0)).alias("total_revenue"),
    ).withColumn("facts", row).select(
        "total_sources", "premium_count", "standard_count", "pause_count", "total_revenue",
        risk.alias("revenue_at_risk"),
        *[F.col(f"facts.{c}") for c in ("high_risk_count", "optimization_opportunity", "top_performers", "at_risk_performers",
                                     "positive_anomalies", "negative_anomalies")],
        clusters.alias("cluster_summary"),
        F.lit(filter_context).alias("filter_context"),
    )
