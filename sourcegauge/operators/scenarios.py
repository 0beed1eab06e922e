"""What-if scenarios and alerts: one summary row each, members as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lookup import one_of, pick
from ..functions.numbers import fixed_text, grouped_text
from ..schema import COHORT, ORD
from ..settings import PAUSE, PROMOTE, WARN
from .cohorts import portfolio_medians
from .signals import Insights

# Scenario and alert texts.
SCENARIOS = {
    1: "Promote All Eligible to Premium",
    2: "Pause All Critical Sources",
    3: "Remediate Watch List Sources",
    4: "Quality Improvement Initiative",
}
SEVERITY_RANK = {"critical": 0, "warning": 1, "opportunity": 2, "info": 3}
ALERTS = {
    # rule: (severity, category, urgency, suggested action)
    1: ("critical", "quality", "immediate",
        "Review and pause traffic immediately. Schedule partner calls to discuss quality improvement plans."),
    2: ("warning", "quality", "this_week",
        "Contact partners to discuss quality improvement plans. Set calendar reminder for 14-day review."),
    3: ("opportunity", "opportunity", "today",
        "Review and approve promotions. Update partner agreements to reflect Premium status."),
    4: ("warning", "risk", "this_week",
        "Diversify revenue sources. Identify and develop backup sources in the same vertical."),
    5: ("info", "quality", "this_month",
        "Review cohort-specific quality standards. Consider vertical-specific optimization programs."),
    6: ("warning", "risk", "this_week",
        "Prioritize quality monitoring and partner engagement for these critical sources."),
    7: ("opportunity", "opportunity", "this_month",
        "Create focused improvement plans for the underperforming metric. Consider incentive programs."),
}


def _number(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def _memberships(sources: DataFrame, rules: dict[int, Column]) -> DataFrame:
    """One row per (rule, source) that meets it."""
    met = F.array_compact(F.array(*[F.when(c, F.lit(no)) for no, c in rules.items()]))
    return sources.withColumn("rule", met).where(F.size("rule") > 0).withColumn("rule", F.explode("rule"))


# ---- scenarios --------------------------------------------------------------------------

def _scenario_rules() -> dict[int, Column]:
    return {
        1: one_of(F.col("action"), PROMOTE),
        2: one_of(F.col("action"), PAUSE),
        3: F.col("cluster") == 3,
        4: F.col("cluster") == 2,
    }


def what_if_scenarios(insights: Insights) -> DataFrame:
    """Up to four rows: revenue now and after acting. A scenario without members has no row."""
    revenue = F.coalesce("total_revenue", F.lit(0.0))
    rules = _scenario_rules()
    sums = insights.scored.agg(
        F.sum(revenue).alias("all_revenue"),
        *[F.count_if(c).alias(f"n{no}") for no, c in rules.items()],
        *[F.sum(F.when(c, revenue).otherwise(F.lit(0.0))).alias(f"r{no}") for no, c in rules.items()],
    )
    medians = portfolio_medians(insights.base)
    both = medians.select(F.struct("median_premium", "median_other")).scalar()
    known = (F.col("m.median_premium") > 0) & (F.col("m.median_other") > 0)
    observed = F.when(known, F.least(F.lit(2.0), F.greatest(F.lit(1.0), F.try_divide("m.median_premium", "m.median_other")))).otherwise(F.lit(1.0))
    facts = sums.withColumn("m", both).withColumn("observed", observed)
    seen = F.col("observed") > 1
    uplift = F.when(seen, F.col("observed")).otherwise(F.lit(1.15))
    reachable = F.floor(F.col("n4") * 0.10)
    extra = reachable * F.try_divide("r4", "n4") * (F.col("observed") - 1)
    percent = F.when(F.col("all_revenue") > 0, fixed_text(F.try_divide("r2", "all_revenue") * 100, 1)).otherwise("0")

    def row(no: int, exists: Column, affected: Column, projected: Column, change: Column, quality: Column, risk: Column) -> Column:
        # A change relative to zero revenue is unknown.
        relative = F.try_divide(change, F.col(f"r{no}")) * 100
        if no == 2:
            relative = F.lit(-100.0)
        if no == 4:
            relative = F.coalesce(relative, F.lit(0.0))
        return F.when(exists, F.struct(
            F.lit(no).alias("scenario_no"),
            F.lit(SCENARIOS[no]).alias("scenario"),
            affected.cast("bigint").alias("affected_count"),
            F.col(f"r{no}").alias("current_revenue"),
            projected.cast("double").alias("projected_revenue"),
            change.cast("double").alias("revenue_change"),
            relative.cast("double").alias("revenue_change_percent"),
            quality.alias("quality_impact"),
            risk.alias("risk_assessment"),
        ))

    n = {no: F.col(f"n{no}") for no in rules}
    r = {no: F.col(f"r{no}") for no in rules}
    rows = F.array(
        row(1, n[1] > 0, n[1], r[1] * uplift, r[1] * uplift - r[1],
            F.concat(_number(n[1]), F.lit(" sources already meeting Premium quality thresholds")),
            F.concat(F.lit("Low risk - based on "), F.when(seen, F.concat(
                F.lit("observed "), fixed_text((F.col("observed") - 1) * 100, 0), F.lit("% Premium uplift"))).otherwise("conservative 15% estimate"))),
        row(2, n[2] > 0, n[2], F.lit(0.0), -r[2],
            F.concat(F.lit("Removes "), _number(n[2]), F.lit(" sources with metrics in Pause range ("), percent, F.lit("% of total revenue)")),
            F.lit("High priority - these sources have both metrics below minimum thresholds")),
        row(3, n[3] > 0, n[3], r[3] * 0.6, r[3] * 0.6 - r[3],
            F.concat(_number(n[3]), F.lit(" sources have 14-day warnings or declining quality")),
            F.lit("Estimate ~60% can be remediated with focused attention; remaining 40% likely need pause")),
        row(4, n[4] > 3, n[4], r[4] + extra, extra,
            F.concat(F.lit("~"), _number(reachable), F.lit(" of "), _number(n[4]), F.lit(" Stable Standard sources could reach Premium thresholds")),
            F.lit("Medium effort - requires quality coaching and optimization programs")),
    )
    return facts.select(F.inline(F.array_compact(rows)))


def scenario_members(insights: Insights, sample: int | None = None) -> DataFrame:
    """(scenario, source) pairs. ``sample``: list only so many first sources of the last scenario, as a preview."""
    narrow = insights.scored.select(ORD, "sub_id", "action", "cluster")
    rules = _scenario_rules()
    whole = _memberships(narrow, {no: rules[no] for no in (1, 2, 3)}).select(F.col("rule").alias("scenario_no"), ORD, "sub_id")
    stable = narrow.where(rules[4]) if sample is None else narrow.where(rules[4]).orderBy(ORD).limit(sample)
    stable = stable.select(F.lit(4).alias("scenario_no"), ORD, "sub_id")
    enough = narrow.where(rules[4]).select(F.count("*")).scalar() > 3
    return whole.unionByName(stable.where(enough)).withColumn("scenario", pick(F.col("scenario_no"), SCENARIOS))


def scenario_facts(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("scenario", "affected_count", "current_revenue", "projected_revenue", "revenue_change_percent",
                            "quality_impact", "risk_assessment")


# ---- alerts -----------------------------------------------------------------------------

def _alert_rules(total: Column) -> dict[int, Column]:
    return {
        1: one_of(F.col("action"), PAUSE),
        2: one_of(F.col("action"), WARN),
        3: one_of(F.col("action"), PROMOTE),
        6: (F.col("risk_level") == "high") & (F.col("total_revenue") > total * 0.05),
        7: F.col("action") == "keep_standard_close",
    }


def _weak_cohorts(cohorts: DataFrame) -> DataFrame:
    return cohorts.where((F.col("health_score") < 50) & (F.col("source_count") >= 3))


def smart_alerts(insights: Insights, cohorts: DataFrame, health: DataFrame) -> DataFrame:
    """Up to seven rows, ids in rule order. ``cohorts``: cohort intelligence; ``health``: portfolio health."""
    total = insights.moments.select(F.sum("cohort_revenue")).scalar()
    rules = _alert_rules(total)
    revenue = F.coalesce("total_revenue", F.lit(0.0))
    weak = _weak_cohorts(cohorts).select(F.struct(
        F.count("*").alias("n"),
        F.coalesce(F.sum("total_revenue"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.sum("source_count"), F.lit(0)).alias("members"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("total_revenue")).alias("r"), F.col("cohort_name").alias("name")))),
            lambda c: c["name"]), ", ").alias("names"),
    )).scalar()
    facts = insights.scored.agg(
        F.sum(revenue).alias("total"),
        F.max(revenue).alias("largest"),
        *[F.count_if(c).alias(f"n{no}") for no, c in rules.items()],
        *[F.sum(F.when(c, revenue).otherwise(F.lit(0.0))).alias(f"r{no}") for no, c in rules.items()],
    ).withColumns({"weak": weak, "single": health.select("single_source_dependency").scalar()})

    def money(x: Column) -> Column:
        return F.concat(F.lit("$"), grouped_text(x))

    def of_total(x: Column) -> Column:
        return F.concat(F.lit("("), fixed_text(F.try_divide(x, F.col("total")) * 100, 1), F.lit("% of "))

    def row(no: int, exists: Column, title: list, description: list, impact: Column, affected: Column) -> Column:
        severity, category, urgency, suggestion = ALERTS[no]
        return F.when(exists, F.struct(
            F.lit(no).alias("rule"),
            F.lit(severity).alias("severity"),
            F.lit(category).alias("category"),
            F.concat(*title).alias("title"),
            F.concat(*description).alias("description"),
            affected.cast("bigint").alias("affected_count"),
            F.lit(suggestion).alias("suggested_action"),
            impact.alias("potential_impact"),
            F.lit(urgency).alias("urgency"),
        ))

    t = F.lit
    n = {no: F.col(f"n{no}") for no in rules}
    r = {no: F.col(f"r{no}") for no in rules}
    rows = F.array(
        row(1, n[1] > 0, [t("🛑 "), _number(n[1]), t(" Sources Require Immediate PAUSE")],
            [t("These sources have both quality metrics below minimum thresholds. Continuing traffic risks partner relationships and "
               "overall quality scores. Combined revenue impact: "), money(r[1]), t(" "), of_total(r[1]), t("total).")], r[1], n[1]),
        row(2, n[2] > 0, [t("⚠️ "), _number(n[2]), t(" Sources Have 14-Day Warning")],
            [t("These sources have one quality metric in the Pause range. Without improvement, they will need to be paused within "
               "14 days. Revenue at risk: "), money(r[2]), t(".")], r[2] * 0.6, n[2]),
        row(3, n[3] > 0, [t("📈 "), _number(n[3]), t(" Sources Ready for Premium Promotion")],
            [t("These Standard sources are already meeting Premium quality thresholds. Promoting them could unlock approximately "),
             money(r[3] * 0.15), t(" in additional revenue based on observed Premium tier uplift.")], r[3] * 0.15, n[3]),
        row(4, F.col("single"), [t("🎯 High Revenue Concentration Detected")],
            [t("Single source accounts for over 25% of total revenue ("), money(F.col("largest")),
             t("). This creates significant business risk if that source experiences quality issues or decides to leave.")],
            F.col("largest"), F.lit(1)),
        row(5, F.col("weak.n") > 0, [t("📊 "), _number(F.col("weak.n")), t(" Cohorts Underperforming")],
            [t("These vertical/traffic type combinations have health scores below 50%: "), F.col("weak.names"),
             t(". Combined revenue: "), money(F.col("weak.revenue")), t(".")], F.col("weak.revenue") * 0.2, F.col("weak.members")),
        row(6, n[6] > 0, [t("⚡ "), _number(n[6]), t(" High-Revenue Sources at Elevated Risk")],
            [t("These sources each represent >5% of total revenue but have high risk scores. Combined: "), money(r[6]), t(" "),
             of_total(r[6]), t("portfolio).")], r[6], n[6]),
        row(7, n[7] >= 3, [t("🎯 "), _number(n[7]), t(" Sources Close to Premium Threshold")],
            [t("These Standard sources have one metric meeting Premium. Targeted improvement on the other metric could unlock "
               "Premium status. Current revenue: "), money(r[7]), t(".")], r[7] * 0.15, n[7]),
    )
    listed = facts.select(F.posexplode(F.array_compact(rows)).alias("place", "alert"))
    return listed.select(
        F.concat(F.lit("alert_"), (F.col("place") + 1).cast("string")).alias("alert_id"), "alert.*",
        pick(F.col("alert.severity"), SEVERITY_RANK).alias("severity_rank"),
    )


def alert_order() -> list[Column]:
    return [F.col("severity_rank"), F.col("rule")]


def sorted_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(*alert_order())


def alert_members(insights: Insights, cohorts: DataFrame, health: DataFrame, sample: int | None = None) -> DataFrame:
    """(rule, source) pairs behind the alerts. ``sample``: list only so many first sources of each weak cohort, as a preview."""
    total = insights.moments.select(F.sum("cohort_revenue")).scalar()
    narrow = insights.scored.select(ORD, "sub_id", *COHORT, "action", "risk_level", "total_revenue")
    whole = _memberships(narrow, _alert_rules(total))
    close = narrow.where(F.col("action") == "keep_standard_close").select(F.count("*")).scalar()
    whole = whole.where((F.col("rule") != 7) | (close >= 3)).select("rule", ORD, "sub_id")
    single = health.select("single_source_dependency").scalar()
    largest = narrow.orderBy(F.col("total_revenue").desc(), ORD).limit(1).where(single).select(F.lit(4).alias("rule"), ORD, "sub_id")
    weak = _weak_cohorts(cohorts).select(*COHORT)
    members = narrow.join(weak, list(COHORT), "left_semi")
    if sample is not None:
        # row_number with a small limit: Spark prunes to a few rows per cohort before it shuffles.
        place = F.row_number().over(W.partitionBy(*COHORT).orderBy(ORD))
        members = members.withColumn("place", place).where(F.col("place") <= sample)
    return whole.unionByName(largest).unionByName(members.select(F.lit(5).alias("rule"), ORD, "sub_id"))
