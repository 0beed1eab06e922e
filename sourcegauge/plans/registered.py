"""Named queries over the star-schema tables, one per operator.

Each takes a session and a folder of tables and returns plain columns: lists are joined to
text and averages rounded, so that results can be compared across engines.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_number, threshold_text
from ..operators import decisions, portfolio, rollup, scenarios, selection, signals, views
from ..operators.classify import action_stats, classify, current_tier, is_unmapped
from ..operators.ordering import positions
from ..operators.report import direct_metrics, outbound_on_leads, performance_report
from ..operators.signals import Insights
from ..schema import MEASURES
from ..session import freeze, shared_folder
from ..settings import REQUIRED_COLUMNS, VERTICALS
from ..sinks.export import export_rows
from ..sinks.facts import FactStore
from ..sinks.history import HistoryStore
from ..sinks.listing import StoredView
from ..sinks.runs import RunStore
from ..sinks.states import DailyStates
from ..sources.star import StarTables
from ..sources.thresholds import threshold_table, with_overrides
from ..sources.upload import auto_map, parse_rows, read_csv, require_rows, rows_of_report
from ..sources.warehouse import in_window, latest_snapshot, named_sources
from .pipelines import Analysis, record_counts

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WINDOW = (dt.date(1998, 6, 1), dt.date(1998, 7, 1))
QUARTER = (dt.date(1998, 5, 1), dt.date(1998, 7, 31))
# Adjoining windows, which together hold every date.
RUNS = {"early": (dt.date(1900, 1, 1), dt.date(1996, 12, 31)), "middle": (dt.date(1997, 1, 1), dt.date(1998, 12, 31)),
        "late": (dt.date(1999, 1, 1), dt.date(2199, 12, 31))}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTERED[fn.__name__] = fn
    return fn


def _report(spark: SparkSession, folder: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    tables = StarTables(spark, folder)
    return performance_report(tables.facts(), tables.dimension(), start, end, link_facts=tables.link_facts())


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of_report(_report(spark, folder))


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return classify(_rows(spark, folder))


def _analysis(spark: SparkSession, folder: str) -> Analysis:
    return Analysis(_classified(spark, folder))


def _insights(spark: SparkSession, folder: str) -> Insights:
    return Insights(_classified(spark, folder))


def _insight_base(spark: SparkSession, folder: str) -> DataFrame:
    return signals.insight_scope(_classified(spark, folder))


def _join(items: str | Column, sep: str = "; ") -> Column:
    return F.array_join(items, sep)


def _rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


# ---- report -----------------------------------------------------------------------------

@query
def report_direct_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return direct_metrics(named_sources(in_window(StarTables(spark, folder).facts(), None, None))).drop(
        "top_placement", "top_channel", "session_leads")


@query
def report_top_placement(spark: SparkSession, folder: str) -> DataFrame:
    return direct_metrics(named_sources(in_window(StarTables(spark, folder).facts(), None, None))).select(
        "sub_id", "vertical", "top_placement", "top_channel")


@query
def report_outbound_link(spark: SparkSession, folder: str) -> DataFrame:
    return outbound_on_leads(named_sources(in_window(StarTables(spark, folder).link_facts(), None, None)))


@query
def report_outbound_link_deduped(spark: SparkSession, folder: str) -> DataFrame:
    return outbound_on_leads(named_sources(in_window(StarTables(spark, folder).link_facts(), None, None)), dedupe_sessions=True)


@query
def report_full(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder).drop("fact_vertical")


@query
def report_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The report's listing: rank by revenue."""
    rows = _rows(spark, folder).select("ord", "sub_id", "vertical", "total_revenue")
    return positions(rows, [], [F.col("ord")]).select("sub_id", "vertical", "total_revenue", "position")


@query
def report_window(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, *WINDOW).drop("fact_vertical")


@query
def report_window_states(spark: SparkSession, folder: str) -> DataFrame:
    """The window's report from daily states of the quarter it lies in."""
    tables, states = StarTables(spark, folder), DailyStates(spark, f"{shared_folder(spark)}/states/{uuid.uuid4().hex}")
    states.add(tables.facts(), *QUARTER, link_facts=tables.link_facts())
    return states.report(tables.dimension(), *WINDOW).drop("fact_vertical")


@query
def report_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The whole report from facts that are stored in buckets by session; sessions of more than six facts lie apart."""
    tables, key = StarTables(spark, folder), uuid.uuid4().hex
    store = FactStore(spark, f"facts_{key}", f"{shared_folder(spark)}/facts/{key}", hot_rows=6)
    store.add(tables.facts().withColumn("date_platform", F.date_trunc("year", "date_platform").cast("date")))
    return store.report(tables.dimension()).drop("fact_vertical")


@query
def latest_snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    return latest_snapshot(StarTables(spark, folder).dimension())


# ---- upload -----------------------------------------------------------------------------

@query
def numeric_prefix_parse(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    whole = F.col("l_quantity").cast("bigint").cast("string")
    kind = F.col("l_linenumber")
    cell = (
        F.when(kind == 1, F.concat(whole, F.lit("abc")))
        .when(kind == 2, F.concat(F.lit("  -"), whole, F.lit(".5x")))
        .when(kind == 3, F.concat(F.lit("$"), whole))
        .when(kind == 4, F.lit(""))
        .when(kind == 5, F.concat(whole, F.lit("e2")))
        .when(kind == 6, F.concat(whole, F.lit(",500")))
    )
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cell.alias("cell")).withColumn(
        "parsed", parse_number(F.col("cell")))


def _upload(spark: SparkSession, folder: str, sep: str, description: Column | None = None) -> DataFrame:
    """The cells of the report written as an upload."""
    path = f"{shared_folder(spark)}/uploads/{uuid.uuid4().hex}"
    _report(spark, folder).select(
        F.col("sub_id").alias("Sub ID"), F.col("traffic_type").alias("Traffic Type"), F.col("vertical").alias("VERTICAL"),
        "internal_channel", "placement", "channel", (F.col("description") if description is None else description).alias("description"),
        F.col("source_name").alias("ad_source"), F.col("media_type").alias("Media Type Name"), "campaign_type", "call_volume", "paid_calls", "calls_over_threshold",
        "call_revenue", "total_leads_dialed", F.col("leads_transferred").alias("transfers"), "lead_revenue",
        F.col("click_volume").alias("clicks"), "click_revenue", F.col("redirect_volume").alias("redirects"),
        "redirect_revenue", F.concat(F.col("total_revenue").cast("bigint").cast("string"), F.lit(" USD")).alias("revenue"),
    ).write.option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"').csv(path)
    return read_csv(spark, path)


def _uploaded(spark: SparkSession, folder: str, sep: str, description: Column | None = None) -> DataFrame:
    raw = _upload(spark, folder, sep, description)
    return parse_rows(raw, auto_map(raw.columns)).drop("ord")


@query
def csv_upload(spark: SparkSession, folder: str) -> DataFrame:
    """The report written as CSV under upload headers and read back as an upload."""
    return _uploaded(spark, folder, ",")


@query
def csv_upload_semicolon(spark: SparkSession, folder: str) -> DataFrame:
    """The same with semicolons, which the reader finds out."""
    return _uploaded(spark, folder, ";")


@query
def csv_upload_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same with cells of several lines, quotes and separators; files are split wherever blocks end."""
    said = F.concat(F.col("description"), F.lit('\n"'), F.col("source_name"), F.lit('", first,\n\nsecond'))
    return _uploaded(spark, folder, ",", said)


@query
def upload_record_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed rows of an upload, and the records they are rolled up to."""
    return record_counts(_uploaded(spark, folder, ",").withColumn("ord", F.col("sub_id")), "overall")


@query
def upload_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether uploads are accepted: the whole one, each vertical's and a vertical's that has none; then the whole one without one required header each."""
    raw = freeze(_upload(spark, folder, ","), "upload")
    checked = []
    for name, part in {"all": raw, **{v: raw.where(F.col("VERTICAL") == v) for v in (*VERTICALS, "None")}}.items():
        checked.append((name, "", part))
    mapping = auto_map(raw.columns)
    checked += [("all", key, raw.drop(mapping[key])) for key in REQUIRED_COLUMNS]

    def verdict(name: str, left_out: str, part: DataFrame) -> DataFrame:
        try:
            rows, refused = parse_rows(require_rows(part)).select(F.count(F.lit(1)).alias("parsed_rows")), F.lit(None).cast("string")
        except ValueError as refusal:
            rows, refused = part.where("false").select(F.count(F.lit(1)).alias("parsed_rows")), F.lit(str(refusal))
        return rows.select(F.lit(name).alias("upload"), F.lit(left_out).alias("left_out"), "parsed_rows", refused.alias("refused"))

    first, *others = [verdict(*x) for x in checked]
    for other in others:
        first = first.unionByName(other)
    return first


# ---- decisions --------------------------------------------------------------------------

@query
def current_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Current tier of every spelling of a channel found in the sources."""
    rows = _rows(spark, folder)
    spelled = F.transform(F.array(F.lit("{}"), F.lit(" {} "), F.lit("")), lambda p: F.replace(p, F.lit("{}"), F.coalesce("internal_channel", F.lit("null"))))
    cells = rows.select("sub_id", F.explode(F.array_union(spelled, F.transform(spelled, lambda s: F.upper(s)))).alias("channel_text"))
    return cells.select("sub_id", "channel_text", current_tier(F.col("channel_text")).alias("current_classification"),
                        is_unmapped(F.col("channel_text")).alias("is_unmapped"))


@query
def metric_tiers(spark: SparkSession, folder: str) -> DataFrame:
    fields = ("value", "volume", "has_insufficient_volume", "tier", "premium_min", "standard_min", "pause_max", "target")
    return _classified(spark, folder).select(
        "sub_id", "vertical", *[F.col(f"{m}_cls.{f}").alias(f"{m}_{f}") for m in ("call", "lead") for f in fields],
        threshold_text(F.col("call_cls.standard_min")).alias("call_standard_text"),
        threshold_text(F.col("lead_cls.standard_min")).alias("lead_standard_text"),
    )


@query
def classify_actions(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).groupBy("vertical", "traffic_type", "action", "recommended_classification").agg(
        F.count("*").alias("sources"), F.sum("total_revenue").alias("revenue"))


@query
def classify_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).select(
        "sub_id", "vertical", "traffic_type", "internal_channel", "current_classification", "is_unmapped", "call_quality_rate",
        "lead_transfer_rate", "action", "action_label", "recommended_classification", "classification_reason", "has_warning",
        "warning_reason", "is_paused", "pause_reason", "has_insufficient_volume", "insufficient_volume_reason", "premium_min",
        "standard_min", "dimension")


@query
def action_counters(spark: SparkSession, folder: str) -> DataFrame:
    return action_stats(_classified(spark, folder))


@query
def rp_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).select("sub_id", "vertical", "rp_lead", "rp_qcall", "rp_click", "rp_redirect")


# ---- rollups ----------------------------------------------------------------------------

def _rolled(dimension: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = rollup.rollup(_rows(spark, folder), dimension)
        return classify(rows, dimension=dimension).select(
            "sub_id", "vertical", "traffic_type", "internal_channel", *MEASURES, "call_quality_rate", "lead_transfer_rate",
            "action", "recommended_classification", "dimension")
    run.__name__ = f"rollup_{dimension}"
    return run


for _d in ("source_name", "placement", "media_type", "overall"):
    query(_rolled(_d))


@query
def rollup_metadata(spark: SparkSession, folder: str) -> DataFrame:
    texts = ("channel", "placement", "description", "source_name", "media_type", "campaign_type")
    return rollup.rollup(_rows(spark, folder), "media_type").select("sub_id", "vertical", "traffic_type", "internal_channel", *texts)


# ---- views ------------------------------------------------------------------------------

def _mode(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return views.metric_mode(_classified(spark, folder), mode).select(
            "sub_id", "vertical", "action", "action_label", "recommended_classification", "is_paused", "classification_reason", "has_warning")
    run.__name__ = f"mode_{mode}"
    return run


for _m in ("call", "lead"):
    query(_mode(_m))


@query
def view_counters(spark: SparkSession, folder: str) -> DataFrame:
    return views.view_stats(views.filtered(views.metric_mode(_classified(spark, folder), "lead"), traffic_type="Full O&O"))


@query
def perf_status(spark: SparkSession, folder: str) -> DataFrame:
    return views.performance_status(_classified(spark, folder)).select("sub_id", "vertical", "call_status", "lead_status")


@query
def quality_remarks(spark: SparkSession, folder: str) -> DataFrame:
    return views.quality_remarks(_classified(spark, folder)).select("sub_id", "vertical", _join("remarks").alias("remarks"))


@query
def explanation(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.transform("details", lambda d: F.concat_ws(": ", d["label"], d["value"], d["status"]))
    return views.explanation(_classified(spark, folder)).select("sub_id", "vertical", "explanation", _join(parts).alias("details"))


@query
def explanation_not_primary(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.transform("details", lambda d: F.concat_ws(": ", d["label"], d["value"], d["status"]))
    # Every source explained as if the call metric were not its own.
    view = _classified(spark, folder).withColumn("action", F.lit("not_primary"))
    return views.explanation(view, "call").select("sub_id", "vertical", "explanation", _join(parts).alias("details"))


@query
def revenue_mix(spark: SparkSession, folder: str) -> DataFrame:
    return views.revenue_mix(_classified(spark, folder)).select("sub_id", "vertical", "call_share", "lead_share", "click_share", "redirect_share")


@query
def revenue_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return views.revenue_breakdown(_classified(spark, folder)).drop("ord")


@query
def revenue_share_in_vertical(spark: SparkSession, folder: str) -> DataFrame:
    return views.revenue_context(_classified(spark, folder)).drop("ord")


@query
def filter_sort_page(spark: SparkSession, folder: str) -> DataFrame:
    view = views.filtered(_classified(spark, folder), traffic_type="Non O&O", category="correct")
    return views.page_of(view, number=2, size=10).select("sub_id", "vertical", "action", "total_revenue")


@query
def locate_page(spark: SparkSession, folder: str) -> DataFrame:
    view = freeze(_classified(spark, folder).select("ord", "sub_id", "media_type", "total_revenue"), "view")
    return views.locate(view, view.where("media_type = 'Search'"), size=25)


def _stored_view(view: DataFrame) -> StoredView:
    return StoredView.write(view, f"{shared_folder(view.sparkSession)}/views/{uuid.uuid4().hex}")


@query
def stored_page(spark: SparkSession, folder: str) -> DataFrame:
    """The page of ``filter_sort_page`` out of a view stored in its order."""
    view = views.filtered(_classified(spark, folder), traffic_type="Non O&O", category="correct")
    return _stored_view(view.select("ord", "sub_id", "vertical", "action", "total_revenue")).page(2, size=10).drop("ord")


@query
def stored_places(spark: SparkSession, folder: str) -> DataFrame:
    """The places of ``locate_page`` out of a view stored in its order."""
    view = freeze(_classified(spark, folder).select("ord", "sub_id", "media_type", "total_revenue"), "view")
    return _stored_view(view).locate(view.where("media_type = 'Search'"))


@query
def distinct_media(spark: SparkSession, folder: str) -> DataFrame:
    return views.distinct_values(_classified(spark, folder), "media_type")


def _selection(view: DataFrame) -> DataFrame:
    picked = selection.select_category(selection.no_selection(view), view, "promote")
    return selection.select_category(picked, view, "below")


@query
def selection_sets(spark: SparkSession, folder: str) -> DataFrame:
    view = freeze(_classified(spark, folder).select("sub_id", "action", "media_type"), "view")
    return selection.toggle(_selection(view), view.where("media_type = 'Social'"))


@query
def selection_compare_groups(spark: SparkSession, folder: str) -> DataFrame:
    view = freeze(_classified(spark, folder).drop("call_cls", "lead_cls"), "view")
    return selection.compare_groups(view, _selection(view))


@query
def selection_compare_total(spark: SparkSession, folder: str) -> DataFrame:
    view = freeze(_classified(spark, folder).drop("call_cls", "lead_cls"), "view")
    return selection.compare_total(view, _selection(view)).withColumn("verticals", _join("verticals"))


# ---- insights per source ----------------------------------------------------------------

@query
def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return _insights(spark, folder).compared.select(
        "sub_id", "cohort_name", "is_anomaly", "anomaly_type", *_rounded("call_z", "lead_z", "revenue_z"),
        _join("anomaly_reasons").alias("anomaly_reasons"))


@query
def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return signals.with_clusters(_insight_base(spark, folder)).select(
        "sub_id", "vertical", "cluster", "cluster_label", "cluster_description", "composite_score")


@query
def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = signals.cluster_summary(signals.with_clusters(_insight_base(spark, folder)))
    return summary.select("cluster_id", "label", "description", "sources", "total_revenue",
                          *_rounded("avg_call_quality", "avg_lead_quality", "avg_revenue"))


@query
def cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    return signals.cluster_members(signals.with_clusters(_insight_base(spark, folder)), 3).drop("ord")


@query
def risk_scores(spark: SparkSession, folder: str) -> DataFrame:
    return signals.with_risk(_insight_base(spark, folder)).select(
        "sub_id", "vertical", "risk_score", "risk_level", "risk_confidence", _join("risk_factors").alias("risk_factors"))


@query
def peer_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _insights(spark, folder).sources.select(
        "sub_id", "peer_group", "peer_count", "call_percentile", "lead_percentile", "revenue_percentile", "overall_percentile")


@query
def cohort_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    cohorts = _insights(spark, folder).cohorts
    return cohorts.select("vertical", "traffic_type", "peers", "premium_peers", "other_peers", "median_premium", "median_other",
                          signals.impact_multiplier().alias("impact_multiplier"),
                          signals.opportunity_multiplier().alias("opportunity_multiplier"))


@query
def revenue_impacts(spark: SparkSession, folder: str) -> DataFrame:
    return _insights(spark, folder).sources.select(
        "sub_id", "vertical", "total_revenue", *_rounded("projected_revenue", "potential_gain", "potential_loss", digits=4),
        "impact_action", "impact_confidence")


@query
def momentum(spark: SparkSession, folder: str) -> DataFrame:
    return _insights(spark, folder).sources.select(
        "sub_id", "vertical", "quality_momentum", "volume_momentum", "trajectory", "revenue_efficiency", "performance_index",
        "momentum_confidence")


@query
def opportunity_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _insights(spark, folder).sources.select(
        "sub_id", "vertical", "opportunity_type", "impact_score", "urgency_score", "priority_score", "potential_revenue",
        "opportunity_action", "timeframe", "opportunity_confidence", "rationale")


@query
def priority_top(spark: SparkSession, folder: str) -> DataFrame:
    return views.priority_list(_insights(spark, folder).sources, "remediate", 3).select("sub_id", "opportunity_type", "priority_score")


@query
def opportunity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return views.counts_by(_insights(spark, folder).sources, "opportunity_type")


@query
def source_profile(spark: SparkSession, folder: str) -> DataFrame:
    return signals.source_profile(_insights(spark, folder)).drop("ord").withColumn("risk_factors", _join("risk_factors"))


# ---- insights per cohort and portfolio --------------------------------------------------

@query
def cohort_intelligence(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio.cohort_intelligence(_insights(spark, folder)).select(
        "vertical", "traffic_type", "cohort_name", "source_count", "total_revenue",
        *_rounded("revenue_share", "avg_call_quality", "avg_lead_quality", "call_quality_delta", "lead_quality_delta"),
        *_rounded("revenue_delta", digits=3),
        _join("top_performer_traits").alias("top_performer_traits"), _join("common_issues").alias("common_issues"),
        "optimization_potential", "health_score", "risk_concentration")


@query
def cohort_top_performers(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio.top_performers(_insight_base(spark, folder)).select("sub_id", "vertical", "traffic_type", "position", "total_revenue")


@query
def cohorts_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The listing of cohorts: rank by revenue."""
    cohorts = _analysis(spark, folder).cohorts.select("cohort_name", "total_revenue", "health_score")
    return positions(cohorts, [], portfolio.cohort_order()).select("cohort_name", "total_revenue", "health_score", "position")


@query
def portfolio_health(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio.portfolio_health(_insights(spark, folder))


@query
def what_if(spark: SparkSession, folder: str) -> DataFrame:
    return scenarios.what_if_scenarios(_insights(spark, folder)).select(
        "scenario_no", "scenario", "affected_count", "current_revenue",
        *_rounded("projected_revenue", "revenue_change", digits=3), *_rounded("revenue_change_percent"),
        "quality_impact", "risk_assessment")


@query
def what_if_members(spark: SparkSession, folder: str) -> DataFrame:
    return scenarios.scenario_members(_insights(spark, folder)).drop("ord")


@query
def scenario_facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = scenarios.scenario_facts(_analysis(spark, folder).scenarios)
    return facts.withColumns({"projected_revenue": F.round("projected_revenue", 3), "revenue_change_percent": F.round("revenue_change_percent", 6)})


@query
def smart_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder).alerts.withColumn("potential_impact", F.round("potential_impact", 3))


@query
def alerts_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The listing of alerts: rank by severity, then by rule."""
    alerts = _analysis(spark, folder).alerts.select("alert_id", "severity", "severity_rank", "rule")
    return positions(alerts, [], scenarios.alert_order()).select("alert_id", "severity", "position")


@query
def alert_members(spark: SparkSession, folder: str) -> DataFrame:
    a = _analysis(spark, folder)
    return scenarios.alert_members(a.insights, a.cohorts, a.health).drop("ord")


@query
def overall_insights(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder).overall().withColumns({
        "top_performers": _join("top_performers", ", "), "at_risk_performers": _join("at_risk_performers", ", "),
        **{c: F.round(c, 3) for c in ("total_potential_gain", "total_potential_loss", "optimization_opportunity")},
    })


@query
def executive_facts(spark: SparkSession, folder: str) -> DataFrame:
    cluster = F.transform("cluster_summary", lambda c: F.concat_ws(":", c["label"], c["count"]))
    return _analysis(spark, folder).executive_facts().withColumns({
        "top_performers": _join("top_performers", ", "), "at_risk_performers": _join("at_risk_performers", ", "),
        "cluster_summary": _join(cluster, ", "), "optimization_opportunity": F.round("optimization_opportunity", 3)})


@query
def scoped_health(spark: SparkSession, folder: str) -> DataFrame:
    """Portfolio health of one media type only."""
    return Analysis(_classified(spark, folder), media_type="Search").health


# ---- decisions and runs -----------------------------------------------------------------

def _history(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.valid_decisions(StarTables(spark, folder).decisions())


def _stored_history(spark: SparkSession, folder: str) -> HistoryStore:
    store = HistoryStore(spark, f"{shared_folder(spark)}/history/{uuid.uuid4().hex}")
    store.append(StarTables(spark, folder).decisions())
    return store


@query
def history_search(spark: SparkSession, folder: str) -> DataFrame:
    found = decisions.search_history(_stored_history(spark, folder).read(), date_from=dt.date(2024, 1, 5), date_to=dt.date(2024, 1, 20),
                                     vertical="Health", text='"K": 1')
    return decisions.sorted_history(found.drop("created_day"), "total_revenue")


@query
def history_search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """A search over all days that opens only the files whose bitmaps admit the text."""
    store = _stored_history(spark, folder)
    store.index_texts()
    return decisions.search_history(store.read(text="Sub00017"), text="Sub00017").drop("created_day")


@query
def history_by_person(spark: SparkSession, folder: str) -> DataFrame:
    found = decisions.search_history(_stored_history(spark, folder).read(), traffic_type="Full O&O", media_type="Search", person="Ana", text="sub0000")
    return found.drop("created_day")


@query
def history_latest(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.latest_decisions(_stored_history(spark, folder).read().drop("created_day"), limit=50, ties=("sub_id", "action_taken"))


@query
def history_options(spark: SparkSession, folder: str) -> DataFrame:
    parts = [df.select(F.lit(name).alias("filter"), F.col(name).alias("value"))
             for name, df in decisions.filter_options(_history(spark, folder)).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def decision_log(spark: SparkSession, folder: str) -> DataFrame:
    made = decisions.decisions_from(_classified(spark, folder), taken_by=F.lit("Ana"), created_at=F.lit(dt.datetime(2024, 2, 1)))
    return decisions.valid_decisions(made)


def _stored_runs(spark: SparkSession, folder: str) -> RunStore:
    """One run per window, written to a new store."""
    store = RunStore(spark, f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}")
    for i, (run, (start, end)) in enumerate(RUNS.items()):
        store.write(classify(rows_of_report(_report(spark, folder, start, end))), str(start), str(end), f"report_{run}.csv",
                    run_id=run, created_at=dt.datetime(2024, 1, 1 + i))
    return store


@query
def runs_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _stored_runs(spark, folder).latest()


@query
def run_with_results(spark: SparkSession, folder: str) -> DataFrame:
    return _stored_runs(spark, folder).run_with_results("middle").drop("current_tier", "recommended_tier_num", "run_name", "run_updated_at")


@query
def threshold_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions under edited thresholds; the edits come from the suppliers' balances."""
    suppliers = spark.read.parquet(f"{folder}/supplier.parquet")
    percent = F.concat(F.pmod(F.floor("s_acctbal"), F.lit(30)).cast("string"), F.lit(".5%"))
    edits = suppliers.select(
        F.element_at(F.array(*[F.lit(v) for v in ("Medicare", "Health", "Life", "Auto", "Home")]), (F.col("s_nationkey") % 5 + 1).cast("int")).alias("vertical"),
        F.element_at(F.array(*[F.lit(v) for v in ("Full O&O", "Partial O&O", "Non O&O")]), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("traffic_type"),
        F.when(F.col("s_suppkey") % 2 == 0, "call").otherwise("lead").alias("metric"),
        F.when(F.col("s_suppkey") % 4 < 2, "standard_min").otherwise("pause_max").alias("field"),
        F.when(F.col("s_suppkey") % 11 == 0, "n/a").otherwise(percent).alias("raw"),
        F.col("s_suppkey").alias("edit_no"),
    )
    thresholds = freeze(with_overrides(threshold_table(spark), edits), "thresholds")
    return classify(_rows(spark, folder), thresholds, min_calls=100, min_leads=50).select(
        "sub_id", "vertical", "traffic_type", "action", "classification_reason", "standard_min")


@query
def export_view(spark: SparkSession, folder: str) -> DataFrame:
    return export_rows(_classified(spark, folder))
