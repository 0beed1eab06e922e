"""Performance report: one row per (sub_id, vertical) from the transaction facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from ..settings import CALL_SECONDS
from ..sources.warehouse import in_window, latest_snapshot, named_sources


def long_enough(vertical: Column, duration: Column) -> Column:
    """Did a call last as long as its vertical asks for?"""
    limit = F.lit(None).cast("int")
    for name, seconds in CALL_SECONDS.items():
        limit = F.when(vertical == name, F.lit(seconds)).otherwise(limit)
    return duration >= limit


def metric_parts(facts: DataFrame, *by: str) -> DataFrame:
    """Counts and sums per (source, placement, channel) and ``by``: all buffers are numbers, so Spark combines them in hash maps on
    the map side. Parts of different facts merge into those of all by sums and ``best`` by maximum."""
    kind, revenue = F.col("transaction_type"), F.coalesce("revenue", F.lit(0.0))
    quality_call = (kind == "Call") & long_enough(F.col("vertical"), F.col("call_duration"))

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0)))

    measures = {
        "direct_calls": total(kind == "Call", F.col("call_transfers")),
        "direct_paid_calls": total(kind == "Call", F.col("paid_calls")),
        "direct_calls_over_threshold": total(quality_call, F.col("call_transfers")),
        "total_leads": F.count_if(kind == "Lead"),
        "session_leads": F.count_if((kind == "Lead") & F.col("session_id").isNotNull()),
        "lead_revenue": total(kind == "Lead", revenue),
        "total_clicks": total(kind == "Click", F.coalesce("clicks", F.lit(0))),
        "click_revenue": total(kind == "Click", revenue),
        "call_revenue": total(kind == "Call", revenue),
        "redirect_volume": F.count_if(kind == "Redirect"),
        "redirect_revenue": total(kind == "Redirect", revenue),
        "total_revenue": F.sum(revenue),
    }
    assert tuple(measures) == MEASURED
    return facts.groupBy("sub_id", "vertical", "placement", "channel", *by).agg(
        F.max("revenue").alias("best"), *[m.alias(name) for name, m in measures.items()])


#: The measures of ``metric_parts``; all of them are summed.
MEASURED = ("direct_calls", "direct_paid_calls", "direct_calls_over_threshold", "total_leads", "session_leads", "lead_revenue", "total_clicks",
            "click_revenue", "call_revenue", "redirect_volume", "redirect_revenue", "total_revenue")


def metrics_of(parts: DataFrame) -> DataFrame:
    """Metrics of each (sub_id, vertical) from parts, of which a (source, placement, channel) may have several."""

    def top(value: str) -> Column:
        # Highest single revenue wins; NULL revenue sorts last; ties go to the larger value.
        return F.max_by(value, F.struct("best", value))

    return parts.groupBy("sub_id", "vertical").agg(
        top("placement").alias("top_placement"),
        top("channel").alias("top_channel"),
        *[F.sum(name).alias(name) for name in MEASURED],
    )


def direct_metrics(facts: DataFrame) -> DataFrame:
    """Calls, leads, clicks, redirects and revenue of each (sub_id, vertical), in one scan.

    The search for the best placement and channel, whose text buffers need sorted input, sees only the few rows of ``metric_parts``.
    """
    return metrics_of(metric_parts(facts))


def session_calls(facts: DataFrame, *by: str) -> DataFrame:
    """Outbound calls of each session and ``by``, with the transfers over each duration limit. Rows of one session add up."""
    calls = facts.where(
        (F.col("transaction_type") == "Call") & (F.col("call_category") == "Outbound")
        & F.col("session_id").isNotNull()
    )
    transfers = F.coalesce("call_transfers", F.lit(0))
    return calls.groupBy("session_id", *by).agg(
        F.sum(transfers).alias("transfers"),
        F.sum(F.coalesce("paid_calls", F.lit(0))).alias("paid"),
        *[F.sum(F.when(F.col("call_duration") >= s, transfers).otherwise(F.lit(0))).alias(f"over_{s}")
          for s in sorted(set(CALL_SECONDS.values()))],
    )


def session_leads(facts: DataFrame, *by: str) -> DataFrame:
    return facts.where((F.col("transaction_type") == "Lead") & F.col("session_id").isNotNull()).select(
        "sub_id", "vertical", "session_id", *by)


def outbound_on_leads(facts: DataFrame, dedupe_sessions: bool = False) -> DataFrame:
    """Outbound calls credited to the source that owns the lead of the same session.

    A session with several leads counts its calls once per lead, unless ``dedupe_sessions``.
    Both sides are aggregated per session before they meet, so the join is many-to-one and a
    session that occurs in a large part of the facts does not multiply rows.
    """
    per_session = session_calls(facts)
    lead_sessions = session_leads(facts).groupBy("sub_id", "vertical", "session_id").agg(F.count("*").alias("leads"))
    times = F.lit(1) if dedupe_sessions else F.col("leads")
    over = F.lit(0).cast("bigint")
    for name, seconds in CALL_SECONDS.items():
        over = F.when(F.col("vertical") == name, F.col(f"over_{seconds}")).otherwise(over)

    def credited(value: Column) -> Column:
        return F.sum(F.coalesce(value, F.lit(0)) * times)

    return lead_sessions.join(per_session, "session_id", "left").groupBy("sub_id", "vertical").agg(
        F.count("*").alias("lead_count"),
        credited(F.col("transfers")).alias("outbound_transfers"),
        credited(F.col("paid")).alias("outbound_paid_calls"),
        credited(over).alias("outbound_calls_over_threshold"),
    )


def outbound_transfers(facts: DataFrame, dedupe_sessions: bool = False) -> DataFrame:
    """Only the credited transfers, for sources that have any.

    An inner join of the raw leads with one row per session. The session rows are frozen first,
    for two reasons: Spark then broadcasts them when their measured size allows, and the leads
    are not shuffled at all; otherwise the join reads plain shuffles on both sides, and only
    then AQE can split the partition of a session that holds a large part of the leads.
    """
    leads = session_leads(facts)
    if dedupe_sessions:
        leads = leads.distinct()
    calls = freeze(session_calls(facts).select("session_id", "transfers"), "session-calls")
    return leads.join(calls, "session_id").groupBy("sub_id", "vertical").agg(F.sum("transfers").alias("credited"))


def _share(numerator: str, denominator: str, digits: int) -> Column:
    return F.round(F.try_divide(F.col(numerator).cast("double"), F.col(denominator)), digits)


def performance_report(
    facts: DataFrame,
    dimension: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    dedupe_sessions: bool = False,
    link_facts: DataFrame | None = None,
) -> DataFrame:
    """The report in upload shape. Unsorted; see ``sorted_report`` for the listing.

    ``start``, ``end``: both included; None is open. ``plans.pipelines.classify_facts`` sets the usual window of 31 days.
    ``link_facts``: the same rows without placement and channel, where those columns cost a
    join; the session link does not need them.
    """
    direct = direct_metrics(named_sources(in_window(facts, start, end)))
    link_rows = named_sources(in_window(facts if link_facts is None else link_facts, start, end))
    return report_of(direct, outbound_transfers(link_rows, dedupe_sessions), dimension)


def report_of(direct: DataFrame, outbound: DataFrame, dimension: DataFrame) -> DataFrame:
    """The report from direct metrics and credited transfers of each (sub_id, vertical)."""
    snapshot = latest_snapshot(dimension).withColumnRenamed("channel", "dimension_channel")
    # Both aggregates are hash-partitioned on the join key, so the first join moves nothing.
    joined = direct.join(outbound, ["sub_id", "vertical"], "left").join(
        snapshot, F.col("sub_id") == F.col("subid"), "left"
    )
    # No credited call: 0 for a source with session leads, unknown for one without.
    linked = F.when(F.col("session_leads") > 0, F.coalesce("credited", F.lit(0)))
    joined = joined.withColumn("outbound_transfers", linked)
    tier = F.when(F.col("tier") == 1, "Premium").when(F.col("tier") == 2, "Standard").otherwise("")
    return joined.select(
        F.coalesce("subid", "sub_id").alias("sub_id"),
        tier.alias("internal_channel"),
        F.coalesce("traffic_type", F.lit("Unknown")).alias("traffic_type"),
        F.coalesce("vertical_name", "vertical").alias("vertical"),
        # The vertical of the facts: with sub_id the report's key, which the dimension's name is not.
        F.col("vertical").alias("fact_vertical"),
        F.col("direct_calls").alias("total_calls"),
        F.col("direct_paid_calls").alias("paid_calls"),
        _share("direct_paid_calls", "direct_calls", 4).alias("qr_rate"),
        F.col("direct_calls_over_threshold").alias("calls_over_threshold"),
        _share("direct_calls_over_threshold", "direct_paid_calls", 4).alias("call_quality_rate_paid"),
        F.col("total_leads").alias("total_leads_dialed"),
        F.coalesce("outbound_transfers", F.lit(0)).alias("leads_transferred"),
        _share("outbound_transfers", "total_leads", 4).alias("lead_transfer_rate"),
        F.col("top_placement").alias("placement"),
        F.col("top_channel").alias("channel"),
        "description", "source_name",
        F.col("media_type_name").alias("media_type"),
        "campaign_type",
        F.col("total_leads").alias("lead_volume"),
        F.col("direct_calls").alias("call_volume"),
        F.col("total_clicks").alias("click_volume"),
        "redirect_volume",
        F.round("lead_revenue", 2).alias("lead_revenue"),
        F.round("call_revenue", 2).alias("call_revenue"),
        F.round("click_revenue", 2).alias("click_revenue"),
        F.round("redirect_revenue", 2).alias("redirect_revenue"),
        _share("lead_revenue", "total_leads", 2).alias("rp_lead"),
        _share("call_revenue", "direct_paid_calls", 2).alias("rp_qcall"),
        _share("click_revenue", "total_clicks", 2).alias("rp_click"),
        _share("redirect_revenue", "redirect_volume", 2).alias("rp_redirect"),
        F.round("total_revenue", 2).alias("total_revenue"),
    )


def sorted_report(report: DataFrame) -> DataFrame:
    """Highest revenue first."""
    return report.orderBy(F.col("total_revenue").desc(), "sub_id", "vertical", "fact_vertical")
