"""What a reader sees of classified records: metric modes, filters, texts, shares, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import one_of, pick, texts
from ..functions.numbers import fixed_text, grouped_text, percent_text, plain_text
from ..schema import COHORT, ORD
from ..session import freeze
from ..settings import MIN_CALLS, MIN_LEADS, STAT_CATEGORIES, STAT_NAMES
from .ordering import positions

# ---- Fixed values: view texts and bands -------------------------------------------------

RELEVANT_SHARE = 0.10
MODE_LABELS = {
    "review": "🔍 Review",
    "insufficient_volume": "📊 Low Volume",
    "pause_immediate": "🛑 PAUSE TODAY",
    "upgrade_to_premium": "↑ Upgrade to Premium",
    "demote_to_standard": "↓ Demote to Standard",
    "keep_standard": "✓ Standard",
}
NOT_PRIMARY_LABEL = {"call": "📋 N/A - Lead Focused", "lead": "📋 N/A - Call Focused"}

CATEGORY_ACTIONS = {
    "promote": ("upgrade_to_premium",),
    "demote": ("demote_to_standard", "demote_with_warning"),
    "below": ("warning_14_day",),
    "pause": ("pause_immediate",),
    "correct": ("keep_premium", "keep_premium_watch", "keep_standard", "keep_standard_close", "no_premium_available", "not_primary"),
    "insufficient_volume": ("insufficient_volume",),
    "review": ("review", "not_primary"),
}

REMARK_BANDS = {
    # metric: (strong from, moderate from, low below, closing words of the low remark)
    "call": (0.20, 0.15, 0.10, "needs attention"),
    "lead": (0.18, 0.12, 0.08, "needs review"),
}

EXPLANATIONS = {
    # action: (text, status of the two metrics, further (label, value, status))
    "keep_premium": ("This source is meeting Premium targets on all metrics with sufficient volume. No action needed.",
                     "good or neutral", None),
    "keep_premium_watch": ("This Premium source has one metric slipping to Standard range. Keeping at Premium but monitoring closely.",
                           "good or warning", None),
    "demote_to_standard": ("Both metrics have dropped from Premium to Standard range. Demoting from Premium to Standard tier.",
                           "warning", ("Current Tier", None, "neutral")),
    "demote_with_warning": ("One or more metrics hit the Pause range. Premium sources don't get paused immediately - demoting to "
                            "Standard with a 14-day window to fix performance.",
                            "good, warning or bad", ("Warning", "14 days to fix", "bad")),
    "upgrade_to_premium": ("Both metrics are performing at Premium level. This source qualifies for upgrade to Premium tier.",
                           "good", None),
    "keep_standard_close": ("One metric is at Premium level, but not both. Almost qualified for Premium upgrade - keep optimizing.",
                            "good or warning", None),
    "keep_standard": ("Both metrics are in the Standard range. Maintaining current tier.", "neutral", None),
    "no_premium_available": ("This traffic type doesn't have a Premium tier available. Meeting Standard targets.", "neutral", None),
    "warning_14_day": ("One metric has dropped into the Pause range. This source has 14 days to improve performance or traffic "
                       "will be paused.", "good, warning or bad", ("Deadline", "14 days", "bad")),
    "pause_immediate": ("BOTH metrics are in the Pause range. This source should be paused immediately.", "bad", None),
    "insufficient_volume": ("Not enough data to make a classification decision. Minimum volume thresholds not met.", None, None),
}
NOTHING_TO_EXPLAIN = "Unable to determine classification reason."


# ---- one metric only --------------------------------------------------------------------

def metric_mode(classified: DataFrame, mode: str = "both") -> DataFrame:
    """Decide again from the call or the lead metric alone.

    A metric that brings less than a tenth of the revenue (of the volume, without revenue) is
    not judged. Warning fields keep their values from the combined decision.
    """
    if mode == "both":
        return classified
    cls = F.col(f"{mode}_cls")
    revenue, volume = F.col("total_revenue"), F.col("total_calls") + F.col("lead_volume")

    def share(own_revenue: str, own_volume: str) -> Column:
        by_volume = F.when(volume > 0, F.col(own_volume) / volume).otherwise(F.lit(0.0))
        return F.when(revenue > 0, F.col(own_revenue) / revenue).otherwise(by_volume)

    shares = {"call": share("call_revenue", "total_calls"), "lead": share("lead_revenue", "lead_volume")}
    current, tier = F.col("current_classification"), cls["tier"]
    action = (
        F.when(cls.isNull(), "review")
        .when(cls["has_insufficient_volume"], "insufficient_volume")
        .when(shares[mode] < RELEVANT_SHARE, "not_primary")
        .when(tier == "Pause", "pause_immediate")
        .when((tier == "Premium") & (current != "Premium"), "upgrade_to_premium")
        .when((tier == "Standard") & (current == "Premium"), "demote_to_standard")
        .otherwise("keep_standard")
    )
    other = "lead" if mode == "call" else "call"
    not_judged = F.concat(F.lit(f"Source primarily generates {other}s ("), fixed_text(shares[other] * 100, 0),
                          F.lit(f"% of revenue). Not evaluated on {mode} quality."))
    acted = F.col("action")
    return classified.withColumn("action", action).withColumns({
        "action_label": pick(acted, {**MODE_LABELS, "not_primary": NOT_PRIMARY_LABEL[mode]}),
        "is_paused": acted == "pause_immediate",
        "recommended_classification": F.when(acted == "review", current).when(acted == "pause_immediate", "PAUSE")
        .when(acted == "upgrade_to_premium", "Premium").otherwise("Standard"),
        "classification_reason": F.when(acted == "not_primary", not_judged)
        .when(cls.isNotNull(), F.concat(cls["metric_type"], F.lit(" tier: "), tier)).otherwise("No data for selected metric"),
    })


# ---- filters, order, pages --------------------------------------------------------------

def actions_of(category: str) -> tuple[str, ...]:
    """Action codes behind a category; any other word stands for itself."""
    return CATEGORY_ACTIONS.get(category, (category,))


def filtered(classified: DataFrame, vertical: str | None = None, traffic_type: str | None = None,
             media_type: str | None = None, category: str | None = None) -> DataFrame:
    wanted = {"vertical": vertical, "traffic_type": traffic_type, "media_type": media_type}
    for column, value in wanted.items():
        if value is not None:
            classified = classified.where(F.col(column) == value)
    return classified if category is None else classified.where(one_of(F.col("action"), actions_of(category)))


def view_order(direction: str | None = "desc") -> list[Column]:
    """Revenue descending, ascending, or input order; ties in input order."""
    revenue = F.coalesce("total_revenue", F.lit(0.0))
    first = {"desc": [revenue.desc()], "asc": [revenue.asc()], None: []}[direction]
    return [*first, F.col(ORD).asc()]


def page_count(view: DataFrame, size: int = 25) -> DataFrame:
    """One row: how many records and pages the view has."""
    return view.agg(F.count("*").alias("records"), F.ceil(F.count("*") / size).alias("pages"))


def page_of(view: DataFrame, number: int = 1, size: int = 25, direction: str | None = "desc", deep: bool = False) -> DataFrame:
    """One page of the sorted view. Far from its start use ``deep``: positions are counted in slices, and no task keeps the pages before."""
    if deep:
        first = (number - 1) * size
        return positions(view, [], view_order(direction)).where(F.col("position").between(first, first + size - 1)).drop("position", "group_size")
    return view.orderBy(*view_order(direction)).offset((number - 1) * size).limit(size)


def locate(view: DataFrame, sub_ids: list[str] | DataFrame, size: int = 25, direction: str | None = "desc") -> DataFrame:
    """Zero-based position and page of the first row of each wanted sub_id in the sorted view."""
    narrow = view.select(ORD, "sub_id", F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"))
    placed = positions(narrow, [], view_order(direction))
    if isinstance(sub_ids, DataFrame):
        placed = placed.join(sub_ids.select("sub_id").distinct(), "sub_id", "left_semi")
    else:
        placed = placed.where(F.col("sub_id").isin(sub_ids))
    return placed.groupBy("sub_id").agg(F.min("position").alias("position")).withColumn(
        "page", F.floor(F.col("position") / size) + 1)


def view_stats(view: DataFrame) -> DataFrame:
    """Counters of a view; here a not judged source is correct and old short codes count as themselves."""
    table = {**{name: name for name in STAT_NAMES}, **STAT_CATEGORIES, "not_primary": "correct"}
    category = pick(F.col("action"), table)
    return view.agg(*[F.count_if(category == name).alias(name) for name in STAT_NAMES])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Non-empty values of a column, sorted."""
    return df.select(column).where(F.coalesce(column, F.lit("")) != "").distinct().orderBy(column)


# ---- texts per record -------------------------------------------------------------------

def performance_status(classified: DataFrame) -> DataFrame:
    """Status word of each metric."""

    def status(cls: str, volume: str, minimum: int) -> Column:
        c = F.col(cls)
        return (
            F.when(F.col(volume) < minimum, "LOW VOL")
            .when(c.isNull() | (c["tier"] == "Unknown"), "N/A")
            .when(c["value"] >= c["premium_min"], "ON TARGET")
            .when(c["value"] >= c["standard_min"], "MAINTAIN")
            .when(c["value"] <= c["pause_max"], "BELOW MIN")
            .otherwise("ATTENTION")
        )

    return classified.withColumns({
        "call_status": status("call_cls", "total_calls", MIN_CALLS),
        "lead_status": status("lead_cls", "lead_volume", MIN_LEADS),
    })


def quality_remarks(classified: DataFrame) -> DataFrame:
    """Remarks on both rates, or one note that there is too little data."""

    def remark(metric: str, name: str, rate: str, volume: str, minimum: int) -> Column:
        strong, moderate, low, closing = REMARK_BANDS[metric]
        r, v = F.col(rate), F.col(volume)
        text = percent_text(r, 1)
        subject = "call quality" if metric == "call" else "lead transfer"
        judged = F.when(r >= strong, F.concat(F.lit(f"Strong {subject} at "), text)).when(
            r >= moderate, F.concat(F.lit(f"Moderate {subject} at "), text)).when(
            r < low, F.concat(F.lit(f"Low {subject} at "), text, F.lit(f" {closing}")))
        small = F.concat(F.lit(f"{name} volume ("), plain_text(v), F.lit(f") below minimum threshold of {minimum}"))
        return F.when((v >= minimum) & r.isNotNull(), judged).when((v < minimum) & (v > 0), small)

    found = texts(remark("call", "Call", "call_quality_rate", "total_calls", MIN_CALLS),
                  remark("lead", "Lead", "lead_transfer_rate", "lead_volume", MIN_LEADS))
    return classified.withColumn("remarks", F.when(F.size(found) > 0, found).otherwise(
        F.array(F.lit("Insufficient data to assess quality metrics"))))


def explanation(view: DataFrame, mode: str = "both") -> DataFrame:
    """Why a record got its action: a text and (label, value, status) details."""

    def metric_value(rate: str, cls: str) -> Column:
        shown = F.when(F.col(rate).isNotNull(), percent_text(F.col(rate), 1)).otherwise("N/A")
        return F.concat(shown, F.lit(" ("), F.coalesce(F.col(f"{cls}.tier"), F.lit("Unknown")), F.lit(")"))

    def metric_status(rule: str, cls: str) -> Column:
        tier = F.coalesce(F.col(f"{cls}.tier"), F.lit("Unknown"))
        if rule in ("good", "neutral", "warning", "bad"):
            return F.lit(rule)
        if rule == "good or neutral":
            return F.when(tier == "Premium", "good").otherwise("neutral")
        if rule == "good or warning":
            return F.when(tier == "Premium", "good").otherwise("warning")
        return F.when(tier == "Pause", "bad").when(tier == "Premium", "good").otherwise("warning")

    def detail(label: str, value: Column, status: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("value"), status.alias("status"))

    def volume(label: str, column: str, minimum: int) -> Column:
        text = F.concat(grouped_text(F.col(column)), F.lit(f" / {minimum} required"))
        return detail(label, text, F.when(F.col(column) >= minimum, "good").otherwise("warning"))

    revenue = F.col("total_revenue")
    part = {m: F.when(revenue > 0, fixed_text(F.try_divide(F.col(f"{m}_revenue"), revenue) * 100, 0)).otherwise("0") for m in ("call", "lead")}

    def money(label: str, metric: str) -> Column:
        text = F.concat(F.lit("$"), grouped_text(F.col(f"{metric}_revenue")), F.lit(" ("), part[metric], F.lit("%)"))
        return detail(label, text, F.lit("warning" if mode == metric else "good"))

    main, focus = ("leads", "Call") if mode == "call" else ("calls", "Lead")
    not_judged = F.concat(F.lit(f"This source primarily generates {main} ("), part["lead" if mode == "call" else "call"],
                          F.lit(f"% of revenue). {focus} quality is not the primary metric for this source."))
    action = F.col("action")
    no_details = F.array().cast("array<struct<label:string,value:string,status:string>>")
    details = F.when(action == "not_primary", F.array(
        money("Call Revenue", "call"), money("Lead Revenue", "lead"), detail("Evaluation", F.lit("Not Evaluated"), F.lit("neutral"))))
    details = details.when(action == "insufficient_volume", F.array(
        volume("Call Volume", "total_calls", MIN_CALLS), volume("Lead Volume", "lead_volume", MIN_LEADS)))
    for code, (_, rule, extra) in EXPLANATIONS.items():
        if rule is None:
            continue
        items = [detail("Call Quality", metric_value("call_quality_rate", "call_cls"), metric_status(rule, "call_cls")),
                 detail("Lead Transfer", metric_value("lead_transfer_rate", "lead_cls"), metric_status(rule, "lead_cls"))]
        if extra is not None:
            label, value, status = extra
            items.append(detail(label, F.lit(value) if value else F.col("current_classification"), F.lit(status)))
        details = details.when(action == code, F.array(*items))
    text = F.when(action == "not_primary", not_judged).otherwise(F.coalesce(
        pick(action, {a: e[0] for a, e in EXPLANATIONS.items()}),
        F.nullif("classification_reason", F.lit("")), F.lit(NOTHING_TO_EXPLAIN)))
    return view.withColumns({"explanation": text, "details": details.otherwise(no_details)})


# ---- revenue ----------------------------------------------------------------------------

REVENUE_TYPES = {
    # label: (revenue, volume, revenue per unit)
    "Calls": ("call_revenue", "paid_calls", "rp_qcall"),
    "Leads": ("lead_revenue", "lead_volume", "rp_lead"),
    "Clicks": ("click_revenue", "click_volume", "rp_click"),
    "Redirects": ("redirect_revenue", "redirect_volume", "rp_redirect"),
}


def revenue_mix(classified: DataFrame) -> DataFrame:
    """Share of each revenue type in percent, NULL without revenue."""
    total = F.nullif("total_revenue", F.lit(0.0))
    return classified.withColumns({
        f"{name}_share": F.col(f"{name}_revenue") / total * 100 for name in ("call", "lead", "click", "redirect")
    })


def revenue_breakdown(classified: DataFrame) -> DataFrame:
    """Four rows per source: revenue, volume and revenue per unit of each type."""
    rows = F.array(*[
        F.struct(F.lit(label).alias("revenue_type"), F.col(r).alias("revenue"), F.col(v).alias("volume"), F.col(rp).alias("rp"))
        for label, (r, v, rp) in REVENUE_TYPES.items()
    ])
    return classified.select(ORD, "sub_id", F.inline(rows))


def revenue_context(view: DataFrame) -> DataFrame:
    """Share of each row in the revenue of its vertical and of its cohort, in percent."""
    frozen = freeze(view.select(ORD, "sub_id", *COHORT, "total_revenue"), "revenue")
    cohort = freeze(frozen.groupBy(*COHORT).agg(F.sum("total_revenue").alias("cohort_total")), "cohort-revenue")
    vertical = cohort.groupBy("vertical").agg(F.sum("cohort_total").alias("vertical_total"))
    totals = freeze(cohort.join(vertical, "vertical"), "revenue-totals")

    def share(total: str) -> Column:
        return F.when(F.col(total) > 0, F.col("total_revenue") / F.col(total) * 100).otherwise(F.lit(0.0))

    return frozen.join(totals, list(COHORT)).withColumns({
        "vertical_share": share("vertical_total"), "cohort_share": share("cohort_total"),
    })


# ---- opportunities ----------------------------------------------------------------------

def priority_list(sources: DataFrame, opportunity_type: str, k: int | None = None) -> DataFrame:
    """Opportunities of one type by priority; the first k for a preview."""
    listed = sources.where(F.col("opportunity_type") == opportunity_type).orderBy(F.col("priority_score").desc(), ORD)
    return listed if k is None else listed.limit(k)


def counts_by(sources: DataFrame, column: str) -> DataFrame:
    return sources.groupBy(column).agg(F.count("*").alias("sources"))
