"""Per-source insight columns: anomalies, clusters, risk, peers, revenue impact, momentum, opportunity.

Each ``with_*`` function adds columns to a frame of sources; those that compare a source
with its cohort expect the columns of ``cohorts.cohort_profile`` on it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import one_of, pick, texts
from ..functions.numbers import fixed_text, grouped_text, percent_text, plain_text, round_half_up
from ..schema import COHORT, ORD
from ..session import freeze
from ..settings import DEMOTE, PAUSE, PROMOTE, WARN
from .cohorts import distribution, moments, percentile_at, premium

INSIGHT_COLUMNS = (
    ORD, "sub_id", *COHORT, "media_type", "current_classification", "action", "call_quality_rate",
    "lead_transfer_rate", "total_revenue", "lead_volume", "total_calls", "has_insufficient_volume",
)

# ---- Fixed values: rules and texts of the insight columns -------------------------------

CLUSTERS = (
    # id, label, description per source, description in the summary
    (0, "⭐ Elite Performers", "Premium sources meeting all quality targets", "Premium sources meeting all quality targets"),
    (1, "📈 Promotion Ready", "Standard sources meeting Premium thresholds - ready for upgrade", "Standard sources meeting Premium thresholds"),
    (2, "⚖️ Stable Standard", "Standard sources meeting quality requirements", "Standard sources meeting quality requirements"),
    (3, "⚠️ Watch List", "Sources with declining quality or 14-day warnings", "Sources with declining quality or warnings"),
    (4, "🛑 Critical Action", "Sources requiring immediate action - pause or urgent attention", "Sources requiring immediate action"),
    (5, "📊 Low Volume", "Insufficient data for reliable classification", "Insufficient data for classification"),
    (6, "🔍 Needs Review", "Requires manual review", "Requires manual review"),
)

ACTION_RISK = {
    # action: (points, reason)
    "pause_immediate": (40, "PAUSE threshold triggered - both metrics in Pause range"),
    "pause": (40, "PAUSE threshold triggered"),
    "demote_with_warning": (35, "Premium demoted with 14-day warning"),
    "warning_14_day": (30, "14-day warning - one metric in Pause range"),
    "below": (30, "Below minimum quality standards"),
    "demote_to_standard": (20, "Premium source quality dropped to Standard range"),
    "demote": (20, "Recommended for demotion"),
    "keep_premium_watch": (15, "Premium source with one metric slipping"),
    "insufficient_volume": (10, "Insufficient volume for classification"),
    "review": (10, "Requires manual review"),
    "keep_standard_close": (5, "Almost at Premium - one metric meeting targets"),
    "keep_standard": (0, ""),
    "no_premium_available": (0, ""),
    "not_primary": (0, ""),
    "keep_premium": (0, ""),
    "correct": (0, ""),
    "upgrade_to_premium": (0, ""),
    "promote": (0, ""),
}
UNKNOWN_RISK = (5, "Unknown action")

OPPORTUNITIES = {
    # action: (type, urgency, timeframe, recommended action, rationale); <uplift> and <revenue> are filled in
    "upgrade_to_premium": ("promote", 70, "immediate",
                           "Promote to Premium tier - <uplift>% revenue uplift expected",
                           "Already meeting Premium thresholds. Cohort data shows <uplift>% average uplift for Premium sources."),
    "pause_immediate": ("pause", 100, "immediate",
                        "PAUSE immediately - quality below minimum thresholds",
                        "Both metrics in Pause range. Continuing traffic risks partner quality reputation. Revenue at risk: $<revenue>"),
    "warning_14_day": ("remediate", 85, "short-term",
                       "Urgent remediation needed within 14 days",
                       "One metric in Pause range. Without intervention, this source will require pause. Work with partner on quality improvement."),
    "demote_to_standard": ("optimize", 65, "short-term",
                           "Demote to Standard but work on quality improvement plan",
                           "Quality dropped below Premium thresholds. Demotion protects tier integrity. Consider re-promotion program."),
    "keep_premium_watch": ("optimize", 60, "short-term",
                           "Premium source needs attention - one metric slipping",
                           "Premium source with one metric below target. Proactive intervention can prevent demotion."),
    "keep_standard_close": ("optimize", 45, "medium-term",
                            "Near Premium thresholds - targeted improvement could unlock promotion",
                            "One metric already meeting Premium. Focus on improving the other metric for promotion opportunity."),
    "keep_standard": ("investigate", 25, "medium-term",
                      "Stable at Standard - consider quality optimization program",
                      "Meeting Standard requirements. Systematic quality improvements could unlock Premium tier."),
}
OPPORTUNITIES["promote"] = OPPORTUNITIES["upgrade_to_premium"]
OPPORTUNITIES["pause"] = OPPORTUNITIES["pause_immediate"]
OPPORTUNITIES["below"] = OPPORTUNITIES["warning_14_day"]
OPPORTUNITIES["demote"] = OPPORTUNITIES["demote_to_standard"]
OTHER_OPPORTUNITY = ("investigate", 30, "medium-term", "Review and assess manually",
                     "Requires manual review to determine appropriate action.")
TIMEFRAME_WEIGHT = {"immediate": 1.5, "short-term": 1.2, "medium-term": 1.0}

IMPACT_TEXTS = {
    "demote": "Quality issues may lead to reduced traffic and revenue",
    "pause": "PAUSE - stop traffic immediately to protect quality",
    "warn": "14-day warning - quality must improve to avoid pause",
    "premium": "Maintain Premium - continue quality monitoring",
    "standard": "Stable at Standard - meeting quality requirements",
    "other": "Maintain current classification",
}

# -----------------------------------------------------------------------------------------


def _is(*actions: str) -> Column:
    return one_of(F.col("action"), actions)


def _or(x: Column, fallback: float) -> Column:
    """``x``, or the fallback where x is NULL or zero."""
    return F.coalesce(F.nullif(x, F.lit(0).cast("double")), F.lit(float(fallback)))


def _points(*cases: tuple[Column, int]) -> Column:
    """Points of the first case that holds, else 0."""
    out = F.lit(0)
    for condition, points in reversed(cases):
        out = F.when(condition, points).otherwise(out)
    return out


def _cohort_name() -> Column:
    return F.concat("vertical", F.lit(" - "), "traffic_type")


# ---- clusters ---------------------------------------------------------------------------

def with_clusters(sources: DataFrame) -> DataFrame:
    """Rule-based cluster (first matching rule) and a composite quality score."""
    standard = (F.coalesce(F.col("current_classification"), F.lit("")).isin("Standard", ""))
    cluster = (
        F.when(premium() & _is("keep_premium", "correct"), 0)
        .when(_is(*PROMOTE), 1)
        .when(standard & _is("keep_standard", "keep_standard_close", "no_premium_available", "correct", "not_primary"), 2)
        .when(_is("keep_premium_watch", *WARN, "demote_to_standard", "demote"), 3)
        .when(_is(*PAUSE, "demote_with_warning"), 4)
        .when(_is("insufficient_volume") | F.col("has_insufficient_volume"), 5)
        .otherwise(6)
    )
    half = [F.coalesce(F.col(c) * 100, F.lit(50.0)) * 0.5 for c in ("call_quality_rate", "lead_transfer_rate")]
    return sources.withColumn("cluster", cluster).withColumns({
        "cluster_label": pick(F.col("cluster"), {c[0]: c[1] for c in CLUSTERS}),
        "cluster_description": pick(F.col("cluster"), {c[0]: c[2] for c in CLUSTERS}),
        "composite_score": half[0] + half[1],
    })


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """One row per non-empty cluster."""
    return clustered.groupBy(F.col("cluster").alias("cluster_id")).agg(
        F.count("*").alias("sources"),
        F.avg("call_quality_rate").alias("avg_call_quality"),
        F.avg("lead_transfer_rate").alias("avg_lead_quality"),
        F.avg("total_revenue").alias("avg_revenue"),
        F.sum("total_revenue").alias("total_revenue"),
    ).withColumns({
        "label": pick(F.col("cluster_id"), {c[0]: c[1] for c in CLUSTERS}),
        "description": pick(F.col("cluster_id"), {c[0]: c[3] for c in CLUSTERS}),
    })


def cluster_members(clustered: DataFrame, cluster: int) -> DataFrame:
    """Members of one cluster with their score and rates, in input order."""
    return clustered.where(F.col("cluster") == cluster).orderBy(ORD).select(
        ORD, "sub_id", "composite_score", "call_quality_rate", "lead_transfer_rate")


# ---- risk -------------------------------------------------------------------------------

def with_risk(sources: DataFrame) -> DataFrame:
    """Additive risk score 0..100 with its level, factors and confidence."""
    call, lead = F.col("call_quality_rate"), F.col("lead_transfer_rate")
    low = F.col("has_insufficient_volume")
    losing = premium() & _is(*DEMOTE, *PAUSE)
    thin = ~low & ((F.col("total_calls") < 30) | (F.col("lead_volume") < 60))
    call_critical, call_weak = call < 0.25, (call >= 0.25) & (call < 0.40)
    lead_critical, lead_weak = lead < 0.08, (lead >= 0.08) & (lead < 0.15)
    score = (
        pick(F.col("action"), {a: r[0] for a, r in ACTION_RISK.items()}, UNKNOWN_RISK[0])
        + _points((losing, 15), (premium() & _is("keep_premium_watch"), 5))
        + _points((low, 10), (thin, 5))
        + _points((call_critical, 15), (call_weak, 8))
        + _points((lead_critical, 10), (lead_weak, 5))
    )
    reason = pick(F.col("action"), {a: r[1] for a, r in ACTION_RISK.items()}, UNKNOWN_RISK[1])

    def rate_factor(condition: Column, text: str, rate: Column) -> Column:
        return F.when(condition, F.concat(F.lit(text + " ("), percent_text(rate, 1), F.lit(")")))

    factors = texts(
        F.nullif(reason, F.lit("")),
        F.when(losing, "Premium source losing status"),
        F.when(low, F.concat(F.lit("Low volume ("), plain_text(F.col("total_calls")), F.lit(" calls, "),
                             plain_text(F.col("lead_volume")), F.lit(" leads)"))),
        F.when(thin, "Volume near minimum threshold"),
        rate_factor(call_critical, "Call quality critical", call),
        rate_factor(call_weak, "Call quality below target", call),
        rate_factor(lead_critical, "Lead transfer critical", lead),
        rate_factor(lead_weak, "Lead transfer below target", lead),
    )
    confidence = F.lit(100) - _points((call.isNull(), 25)) - _points((lead.isNull(), 25)) - _points((low, 20))
    return sources.withColumn("risk_score", F.least(F.lit(100), score)).withColumns({
        "risk_level": F.when(F.col("risk_score") >= 60, "critical").when(F.col("risk_score") >= 40, "high")
        .when(F.col("risk_score") >= 20, "medium").otherwise("low"),
        "risk_factors": factors,
        "risk_confidence": F.greatest(F.lit(30), confidence),
    })


# ---- comparison with the cohort ---------------------------------------------------------

def with_peers(joined: DataFrame) -> DataFrame:
    """Percentiles within the cohort; overall weighs call 40, lead 40, revenue 20."""
    parts = {"call": ("call_quality_rate", 0.40), "lead": ("lead_transfer_rate", 0.40), "revenue": ("total_revenue", 0.20)}
    out = joined.withColumns({f"{m}_percentile": percentile_at(F.col(f"steps_{m}"), F.col(c)) for m, (c, _) in parts.items()})
    total, weight = F.lit(0.0), F.lit(0.0)
    for m, (_, w) in parts.items():
        p = F.col(f"{m}_percentile")
        total = total + F.coalesce(p * w, F.lit(0.0))
        weight = weight + F.when(p.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    overall = F.when(weight > 0, round_half_up(total / weight)).otherwise(F.lit(50).cast("bigint"))
    return out.withColumns({"overall_percentile": overall, "peer_group": _cohort_name(), "peer_count": F.col("peers")})


def with_anomalies(joined: DataFrame) -> DataFrame:
    """z-scores within the cohort (three peers at least) and what they flag beyond 2.

    Scores are rounded to nine decimals: one outlier among five equal peers has a score of
    exactly 2, and the order in which Spark adds up a deviation must not decide its flag.
    """

    def z(value: str, metric: str, count: str) -> Column:
        distance = F.when(F.col(f"{metric}_sd") == 0, F.lit(0.0)).otherwise(
            (F.col(value) - F.col(f"{metric}_mean")) / F.col(f"{metric}_sd"))
        return F.when(F.col(value).isNotNull() & (F.col(count) >= 3), F.round(distance, 9))

    scored = joined.withColumns({
        "call_z": z("call_quality_rate", "call", "call_peers"),
        "lead_z": z("lead_transfer_rate", "lead", "lead_peers"),
        "revenue_z": z("total_revenue", "revenue", "peers"),
    })
    scores = [F.col(c) for c in ("call_z", "lead_z", "revenue_z")]
    high, low = F.lit(False), F.lit(False)
    for s in scores:
        high, low = high | F.coalesce(s > 2, F.lit(False)), low | F.coalesce(s < -2, F.lit(False))
    falling = premium() & _is(*DEMOTE)
    rising = (F.col("current_classification") == "Standard") & _is(*PROMOTE)
    kind = (
        F.when(F.col("z_low"), "negative").when(F.col("z_high"), "positive")
        .when(falling, "negative").when(rising, "positive").otherwise("none")
    )

    def sigma(s: Column) -> Column:
        return F.concat(fixed_text(F.abs(s), 1), F.lit("σ "))

    def reason(name: str, s: Column, above: Column, below: Column) -> Column:
        side = F.when(s > 2, above).when(s < -2, below)
        return F.concat(F.lit(name + " "), sigma(s), side)

    call_z, lead_z, revenue_z = scores
    peers = F.concat("vertical", F.lit(" "), "traffic_type", F.lit(" peers"))
    revenue_above = F.concat(
        F.lit("above peers ($"), grouped_text(F.col("total_revenue")), F.lit(" vs avg $"),
        grouped_text(F.col("revenue_mean")), F.lit(")"))
    flagged = F.col("z_low") | F.col("z_high")
    reasons = texts(
        reason("Call quality", call_z, F.concat(F.lit("above "), peers), F.concat(F.lit("below "), peers)),
        reason("Lead transfer", lead_z, F.lit("above peers"), F.lit("below peers")),
        reason("Revenue", revenue_z, revenue_above, F.lit("below peers")),
        F.when(~flagged & falling, "Premium source recommended for demotion - quality dropped"),
        F.when(~flagged & rising, "Standard source exceeding Premium thresholds - promotion candidate"),
    )
    return scored.withColumns({"z_high": high, "z_low": low}).withColumns({
        "anomaly_type": kind, "anomaly_reasons": reasons, "cohort_name": _cohort_name(),
    }).withColumn("is_anomaly", F.col("anomaly_type") != "none").drop("z_high", "z_low")


def impact_multiplier() -> Column:
    """Observed Premium over Standard median revenue, between 1 and 2.5; 1 without two sources each."""
    known = (F.col("median_premium") > 0) & (F.col("median_other") > 0) & (F.col("premium_peers") >= 2) & (F.col("other_peers") >= 2)
    return F.when(known, F.least(F.lit(2.5), F.greatest(F.lit(1.0), F.try_divide("median_premium", "median_other")))).otherwise(F.lit(1.0))


def opportunity_multiplier() -> Column:
    """The same ratio between 1 and 2 from one source each; 1.15 where there is no ratio.

    A median of zero below gives the upper bound, 0/0 counts as no ratio.
    """
    ratio = F.when(F.col("median_other") == 0, F.when(F.col("median_premium") > 0, F.lit(2.0)).when(F.col("median_premium") < 0, F.lit(1.0))).otherwise(
        F.try_divide("median_premium", "median_other"))
    both = (F.col("premium_peers") > 0) & (F.col("other_peers") > 0) & ratio.isNotNull()
    return F.when(both, F.least(F.lit(2.0), F.greatest(F.lit(1.0), ratio))).otherwise(F.lit(1.15))


def with_impacts(joined: DataFrame) -> DataFrame:
    """Revenue projected after the recommended action, with gain, loss and confidence."""
    revenue, m = F.col("total_revenue"), F.col("impact_multiplier")
    uplift = F.when(m > 1, m).otherwise(F.lit(1.15))
    cut = F.when(m > 1, 1 / m).otherwise(F.lit(0.85))
    base = F.lit(50) + _points((F.col("peers") >= 10, 20), (F.col("peers") >= 5, 10))
    promoted, demoted, paused, warned = _is(*PROMOTE), _is(*DEMOTE), _is(*PAUSE), _is(*WARN)
    kept_premium, kept_standard = _is("keep_premium", "keep_premium_watch"), _is("keep_standard", "keep_standard_close")
    advice = F.when(promoted, F.concat(F.lit("Promote to Premium - cohort shows "), fixed_text((uplift - 1) * 100, 0), F.lit("% revenue uplift")))
    for condition, key in ((demoted, "demote"), (paused, "pause"), (warned, "warn"), (kept_premium, "premium"), (kept_standard, "standard")):
        advice = advice.when(condition, F.lit(IMPACT_TEXTS[key]))
    return joined.withColumn("impact_multiplier", impact_multiplier()).withColumns({
        "projected_revenue": F.when(promoted, revenue * uplift).when(demoted, revenue * cut)
        .when(paused, F.lit(0.0)).when(warned, revenue * 0.75).otherwise(revenue),
    }).withColumns({
        "potential_gain": F.when(promoted, F.col("projected_revenue") - revenue).otherwise(F.lit(0.0)),
        "potential_loss": F.when(demoted, revenue - F.col("projected_revenue")).when(paused, revenue)
        .when(warned, revenue * 0.25).otherwise(F.lit(0.0)),
        "impact_action": advice.otherwise(F.lit(IMPACT_TEXTS["other"])),
        "impact_confidence": F.when(promoted, F.least(F.lit(85), base + 15)).when(demoted, F.least(F.lit(75), base + 10))
        .when(paused, 95).when(warned, 60).when(kept_premium, 80).when(kept_standard, 75).otherwise(base),
    })


def with_momentum(ranked: DataFrame) -> DataFrame:
    """Direction of quality and volume, efficiency and performance index (needs peers and risk)."""
    call, lead = F.col("call_quality_rate"), F.col("lead_transfer_rate")
    quality = (F.coalesce(call, F.lit(0.0)) + F.coalesce(lead, F.lit(0.0))) / 2
    efficiency = F.when(quality > 0, F.col("total_revenue") / (quality * 100)).otherwise(F.lit(0.0))
    # A percentile of 0 and a risk of 100 count as missing here.
    safety = _or((100 - F.col("risk_score")).cast("double"), 50)
    index = _or(F.col("overall_percentile").cast("double"), 50) * 0.6 + safety * 0.4
    rising = _is(*PROMOTE, "keep_premium")
    falling = _is("demote_to_standard", "demote_with_warning", *PAUSE)
    shaky = _is("warning_14_day", "keep_premium_watch")
    low = F.col("has_insufficient_volume")
    confidence = (F.lit(70) + _points((F.col("peers") >= 10, 15)) + _points((call.isNotNull() & lead.isNotNull(), 10))
                  + _points((~low, 5)))
    return ranked.withColumns({
        "quality_momentum": F.when(rising, "accelerating").when(falling | shaky, "decelerating").otherwise("stable"),
        "trajectory": F.when(rising, "improving").when(falling, "declining").when(shaky, "volatile").otherwise("stable"),
        "volume_momentum": F.when((F.col("total_calls") > 100) | (F.col("lead_volume") > 200), "growing")
        .when(low, "declining").otherwise("stable"),
        "revenue_efficiency": round_half_up(efficiency * 100) / 100,
        "performance_index": round_half_up(index),
        "momentum_confidence": F.least(F.lit(100), confidence),
    })


def with_opportunity(ranked: DataFrame, total_revenue: Column) -> DataFrame:
    """Priority = impact x urgency x confidence x timeframe weight (needs peers)."""
    revenue, m = F.col("total_revenue"), F.col("opportunity_multiplier")
    share = F.col("revenue_share_pct")
    rank = _or(F.col("overall_percentile").cast("double"), 50)
    promoted, paused, warned = _is(*PROMOTE), _is(*PAUSE), _is(*WARN)
    demoted, watched = _is("demote_to_standard", "demote"), _is("keep_premium_watch")
    close, kept = _is("keep_standard_close"), _is("keep_standard")

    def capped(x: Column) -> Column:
        return F.least(F.lit(100.0), x)

    impact = (
        F.when(promoted, capped(share * 3 + rank * 0.5))
        .when(paused, capped(80 + (20 - F.least(F.lit(20.0), share))))
        .when(warned, capped(50 + share * 2))
        .when(demoted, capped(40 + share * 1.5))
        .when(watched, capped(35 + share * 2))
        .when(close, 30 + share)
        .when(kept, F.lit(15.0))
        .otherwise(F.lit(20.0))
    )
    potential = (
        F.when(promoted, revenue * (m - 1)).when(paused, -revenue).when(warned, revenue * 0.6).when(demoted, revenue * 0.3)
        .when(watched, revenue * 0.15).when(close, revenue * (m - 1) * 0.5).when(kept, revenue * (m - 1) * 0.2)
        .otherwise(F.lit(0.0))
    )

    def column(i: int) -> Column:
        return pick(F.col("action"), {a: o[i] for a, o in OPPORTUNITIES.items()}, OTHER_OPPORTUNITY[i])

    uplift = fixed_text((m - 1) * 100, 0)

    def filled(i: int) -> Column:
        return F.replace(F.replace(column(i), F.lit("<uplift>"), uplift), F.lit("<revenue>"), grouped_text(revenue))

    low = F.col("has_insufficient_volume")
    both = F.col("call_quality_rate").isNotNull() & F.col("lead_transfer_rate").isNotNull()
    confidence = F.lit(60) + _points((F.col("peers") >= 10, 20), (F.col("peers") >= 5, 10)) + _points((both, 15)) + _points((~low, 5))
    return ranked.withColumns({
        "opportunity_multiplier": opportunity_multiplier(),
        "revenue_share_pct": F.when(total_revenue > 0, revenue / total_revenue * 100).otherwise(F.lit(0.0)),
    }).withColumns({
        "opportunity_type": column(0),
        "urgency_score": column(1),
        "timeframe": column(2),
        "opportunity_action": filled(3),
        "rationale": filled(4),
        "opportunity_confidence": F.least(F.lit(100), confidence),
        "raw_impact": impact,
        "potential_revenue": round_half_up(potential),
    }).withColumns({
        "impact_score": round_half_up(F.col("raw_impact")),
        "priority_score": round_half_up(
            F.col("raw_impact") * (F.col("urgency_score") / 100) * (F.col("opportunity_confidence") / 100)
            * pick(F.col("timeframe"), TIMEFRAME_WEIGHT) * 100) / 100,
    }).drop("raw_impact")


# ---- the wide frame ---------------------------------------------------------------------

def insight_scope(classified: DataFrame, vertical: str | None = None, traffic_type: str | None = None,
                  media_type: str | None = None) -> DataFrame:
    """Sources the insights run on: filtered by descriptive columns only, never by action or metric."""
    for column, wanted in (("vertical", vertical), ("traffic_type", traffic_type), ("media_type", media_type)):
        if wanted is not None:
            classified = classified.where(F.col(column) == wanted)
    return classified.select(*INSIGHT_COLUMNS)


class Insights:
    """Sources with their insight columns, each group of columns computed when it is asked for.

    The scope is frozen once; cohort statistics are a few rows that Spark broadcasts by their
    measured size, so the sources themselves are never shuffled to get their columns.
    """

    def __init__(self, classified: DataFrame, **scope: str):
        self.base = freeze(insight_scope(classified, **scope), "scope")
        self._kept: DataFrame | None = None

    @cached_property
    def moments(self) -> DataFrame:
        """Counts, means and deviations of each cohort: one aggregation."""
        return freeze(moments(self.base), "moments")

    @cached_property
    def cohorts(self) -> DataFrame:
        """Moments with medians and percentile steps, which need the values in order."""
        return freeze(self.moments.join(distribution(self.base), list(COHORT), "left"), "cohorts")

    @property
    def scored(self) -> DataFrame:
        """Sources with cluster and risk, which depend on the source alone."""
        return self._kept if self._kept is not None else self.base.transform(with_clusters).transform(with_risk)

    @property
    def compared(self) -> DataFrame:
        """Sources with their deviation from their cohort."""
        return self._kept if self._kept is not None else self.base.join(self.moments, list(COHORT), "left").transform(with_anomalies)

    @property
    def sources(self) -> DataFrame:
        """Sources with all columns."""
        if self._kept is not None:
            return self._kept
        total = self.moments.select(F.sum("cohort_revenue")).scalar()
        return (
            self.base.join(self.cohorts, list(COHORT), "left")
            .transform(with_clusters)
            .transform(with_risk)
            .transform(with_peers)
            .transform(with_anomalies)
            .transform(with_impacts)
            .transform(with_momentum)
            .transform(with_opportunity, total)
        )

    def keep(self) -> Insights:
        """Freeze the sources with their columns, where several results read them."""
        if self._kept is None:
            self._kept = freeze(self.sources.drop("steps_call", "steps_lead", "steps_revenue"), "sources")
        return self


def source_profile(insights: Insights) -> DataFrame:
    """Record, risk, peers, cluster and anomaly of each source in one row."""
    return insights.sources.select(
        ORD, "sub_id", *COHORT, "current_classification", "action", "call_quality_rate", "lead_transfer_rate",
        "total_revenue", "risk_score", "risk_level", "overall_percentile", "cluster_label", "is_anomaly",
        "anomaly_type", "risk_factors",
    )
