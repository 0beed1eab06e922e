"""Decision per source: metric tiers, action, texts and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import one_of, pick
from ..functions.numbers import percent_text, plain_text, ratio
from ..schema import COHORT, SOURCE_ROW
from ..settings import ACTION_LABELS, MIN_CALLS, MIN_LEADS, STAT_CATEGORIES, STAT_NAMES
from ..sources.thresholds import threshold_table

# Decision texts. {premium tier exists: text before the metric summary}.
REASONS_WITH_PREMIUM = {
    "demote_with_warning": "Metric(s) in Pause range - demoting to Standard with 14-day warning. ",
    "keep_premium": "All metrics in Premium range. ",
    "keep_premium_watch": "One metric slipping to Standard range - monitoring. ",
    "demote_to_standard": "Both metrics dropped to Standard range. ",
    "pause_immediate": "Both metrics in Pause range - pausing immediately. ",
    "warning_14_day": "One metric in Pause range - 14-day warning. ",
    "upgrade_to_premium": "Both metrics in Premium range - eligible for upgrade. ",
    "keep_standard_close": "One metric at Premium, one at Standard - almost there. ",
    "keep_standard": "Metrics in Standard range. ",
}
REASONS_WITHOUT_PREMIUM = {
    "pause_immediate": "All metrics in Pause range. ",
    "warning_14_day": "One or more metrics in Pause range. ",
}
WARNING_REASONS = {
    "warning_14_day": "Fix within 14 days or traffic will be paused",
    "demote_with_warning": "Demoted from Premium. Fix within 14 days or traffic will be paused.",
    "keep_premium_watch": "Performance declining - monitor closely",
}


def current_tier(channel: Column) -> Column:
    return F.when(F.lower(F.trim(channel)) == "premium", "Premium").otherwise("Standard")


def is_unmapped(channel: Column) -> Column:
    return channel.isNull() | one_of(channel, ("", "null", "undefined"))


def metric_tier(rate: Column, premium: Column, standard: Column, pause: Column) -> Column:
    """Premium, Standard, Pause or Unknown; the gap above ``pause`` counts as Standard."""
    return (
        F.when(rate.isNull() | standard.isNull(), "Unknown")
        .when(rate >= premium, "Premium")
        .when((rate < standard) & (rate <= pause), "Pause")
        .otherwise("Standard")
    )


def _metric(kind: str, rate: str, volume: str, minimum: Column) -> Column:
    """Everything known about one metric, NULL when it has no rate."""
    key = kind.lower()
    limits = {f: F.col(f"{key}_{f}") for f in ("premium_min", "standard_min", "pause_max", "target")}
    tier = metric_tier(F.col(rate), limits["premium_min"], limits["standard_min"], limits["pause_max"])
    return F.when(
        F.col(rate).isNotNull(),
        F.struct(
            F.lit(kind).alias("metric_type"),
            F.col(rate).alias("value"),
            F.col(volume).alias("volume"),
            minimum.cast("double").alias("volume_threshold"),
            (F.col(volume) < minimum).alias("has_insufficient_volume"),
            tier.alias("tier"),
            limits["premium_min"].alias("premium_min"),
            F.coalesce(limits["standard_min"], F.lit(0.0)).alias("standard_min"),
            F.coalesce(limits["pause_max"], F.lit(0.0)).alias("pause_max"),
            limits["target"].alias("target"),
        ),
    )


def with_rates(rows: DataFrame) -> DataFrame:
    """Quality rates and revenue per unit, NULL where the volume is zero."""
    return rows.withColumns({
        "call_quality_rate": ratio(F.col("calls_over_threshold"), F.col("total_calls")),
        "lead_transfer_rate": ratio(F.col("leads_transferred"), F.col("lead_volume")),
        "rp_lead": ratio(F.col("lead_revenue"), F.col("lead_volume")),
        "rp_qcall": ratio(F.col("call_revenue"), F.col("paid_calls")),
        "rp_click": ratio(F.col("click_revenue"), F.col("click_volume")),
        "rp_redirect": ratio(F.col("redirect_revenue"), F.col("redirect_volume")),
    })


def with_current_tier(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "current_classification": current_tier(F.col("internal_channel")),
        "is_unmapped": is_unmapped(F.col("internal_channel")),
    })


def with_metrics(rows: DataFrame, thresholds: DataFrame, min_calls: int = MIN_CALLS, min_leads: int = MIN_LEADS) -> DataFrame:
    """Join the thresholds (a handful of rows, broadcast by its known size) and tier both metrics."""
    joined = rows.join(thresholds, list(COHORT), "left")
    return joined.withColumns({
        "call_cls": _metric("Call", "call_quality_rate", "total_calls", F.lit(min_calls)),
        "lead_cls": _metric("Lead", "lead_transfer_rate", "lead_volume", F.lit(min_leads)),
    })


def _count(*conditions: Column) -> Column:
    total = F.lit(0)
    for condition in conditions:
        total = total + F.when(condition, 1).otherwise(0)
    return total


def decide(metrics: DataFrame) -> DataFrame:
    """Action from both metrics together; only metrics with enough volume take part."""
    active = {c: F.coalesce(~F.col(f"{c}.has_insufficient_volume"), F.lit(False)) for c in ("call_cls", "lead_cls")}

    def tiers(name: str) -> Column:
        return _count(*[on & (F.col(f"{c}.tier") == name) for c, on in active.items()])

    counted = metrics.withColumns({
        "n_active": _count(*active.values()),
        "n_premium": tiers("Premium"),
        "n_pause": tiers("Pause"),
        "premium_possible": F.coalesce("has_premium", F.lit(False)),
    })
    n, good, bad = F.col("n_active"), F.col("n_premium"), F.col("n_pause")
    holds_premium = F.col("premium_possible") & (F.col("current_classification") == "Premium")
    action = (
        F.when(n == 0, "insufficient_volume")
        .when(holds_premium & (bad > 0), "demote_with_warning")
        .when(bad == n, "pause_immediate")
        .when(bad > 0, "warning_14_day")
        .when(~F.col("premium_possible"), "no_premium_available")
        .when(holds_premium, F.when(good == n, "keep_premium").when(good > 0, "keep_premium_watch").otherwise("demote_to_standard"))
        .when(good == n, "upgrade_to_premium")
        .when(good > 0, "keep_standard_close")
        .otherwise("keep_standard")
    )
    recommended = (
        F.when(F.col("action") == "insufficient_volume", F.col("current_classification"))
        .when(F.col("action") == "pause_immediate", "PAUSE")
        .when(one_of(F.col("action"), ("keep_premium", "keep_premium_watch", "upgrade_to_premium")), "Premium")
        .otherwise("Standard")
    )
    return counted.withColumn("action", action).withColumns({
        "recommended_classification": recommended,
        "has_insufficient_volume": F.col("action") == "insufficient_volume",
        "is_paused": F.col("action") == "pause_immediate",
        "has_warning": one_of(F.col("action"), WARNING_REASONS),
    })


def with_texts(decided: DataFrame) -> DataFrame:
    """Label, reason, warning and pause texts."""

    def share(cls: str, name: str) -> Column:
        on = ~F.col(f"{cls}.has_insufficient_volume")
        return F.when(on, F.concat(F.lit(f"{name}: "), percent_text(F.col(f"{cls}.value"), 2), F.lit(" ("), F.col(f"{cls}.tier"), F.lit(")")))

    def shortfall(cls: str, name: str) -> Column:
        low = F.col(f"{cls}.has_insufficient_volume")
        have, need = F.col(f"{cls}.volume"), F.col(f"{cls}.volume_threshold")
        return F.when(low, F.concat(F.lit(f"{name}: "), plain_text(have), F.lit("/"), plain_text(need)))

    summary = F.concat_ws(", ", share("call_cls", "Call"), share("lead_cls", "Lead"))
    lacking = F.concat_ws(", ", shortfall("call_cls", "Call"), shortfall("lead_cls", "Lead"))
    low_text = F.concat(F.lit("Insufficient volume: "), F.when(lacking == "", "No data").otherwise(lacking))
    action = F.col("action")
    lead_in = (
        F.when(action == "no_premium_available",
               F.concat(F.lit("Meeting Standard targets (Premium not available for "), F.col("traffic_type"), F.lit("). ")))
        .when(F.col("premium_possible"), pick(action, REASONS_WITH_PREMIUM))
        .otherwise(pick(action, REASONS_WITHOUT_PREMIUM))
    )
    low = F.col("has_insufficient_volume")
    return decided.withColumns({
        "action_label": pick(action, ACTION_LABELS),
        "insufficient_volume_reason": F.when(low, low_text),
        "classification_reason": F.when(low, low_text).otherwise(F.concat(lead_in, summary)),
        "warning_reason": pick(action, WARNING_REASONS),
    }).withColumn("pause_reason", F.when(F.col("is_paused"), F.col("classification_reason")))


RESULT_COLUMNS = (
    *SOURCE_ROW, "dimension", "current_classification", "is_unmapped", "call_quality_rate", "lead_transfer_rate",
    "rp_lead", "rp_qcall", "rp_click", "rp_redirect", "call_cls", "lead_cls", "recommended_classification",
    "action", "action_label", "classification_reason", "has_warning", "warning_reason", "is_paused", "pause_reason",
    "has_insufficient_volume", "insufficient_volume_reason", "premium_min", "standard_min",
)


def classify(
    rows: DataFrame,
    thresholds: DataFrame | None = None,
    dimension: str = "sub_id",
    min_calls: int = MIN_CALLS,
    min_leads: int = MIN_LEADS,
) -> DataFrame:
    """Classified records from source rows (or rolled-up rows). One narrow pass, no shuffle."""
    thresholds = threshold_table(rows.sparkSession) if thresholds is None else thresholds
    decided = (
        rows.transform(with_current_tier)
        .transform(with_rates)
        .transform(with_metrics, thresholds, min_calls, min_leads)
        .transform(decide)
        .transform(with_texts)
    )
    shown = F.col("premium_possible") & (F.col("n_active") > 0)
    return decided.withColumns({
        "dimension": F.lit(dimension),
        "premium_min": F.when(shown, F.col("call_premium_min")),
        "standard_min": F.when(shown, F.col("call_standard_min")),
    }).select(*RESULT_COLUMNS)


def stat_category(action: Column) -> Column:
    """Counter of an action; anything unknown counts as review."""
    return pick(action, STAT_CATEGORIES, "review")


def action_stats(classified: DataFrame) -> DataFrame:
    """One row: number of records and one counter per category."""
    category = stat_category(F.col("action"))
    return classified.agg(
        F.count("*").alias("total_records"),
        *[F.count_if(category == name).alias(name) for name in STAT_NAMES],
    )
