"""The three entry points: facts to report, rows to decisions, decisions to insights."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import portfolio, scenarios
from ..operators.classify import classify
from ..operators.report import performance_report
from ..operators.rollup import Dimension, rollup
from ..operators.signals import Insights
from ..session import freeze
from ..sources.upload import auto_map, parse_rows, read_csv, require_rows, rows_of_report
from ..sources.warehouse import last_n_days


def classify_csv(spark: SparkSession, path: str, dimension: Dimension | str = Dimension.SUB_ID,
                 mapping: dict[str, str] | None = None, multi_line: bool = True) -> DataFrame:
    """Upload to decisions along one dimension."""
    raw = require_rows(read_csv(spark, path, multi_line))
    rows = parse_rows(raw, mapping or auto_map(raw.columns))
    return classify(rollup(rows, dimension), dimension=Dimension(dimension).value)


def classify_facts(facts: DataFrame, sources: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                   dimension: Dimension | str = Dimension.SUB_ID, link_facts: DataFrame | None = None, all_dates: bool = False) -> DataFrame:
    """Transaction facts to decisions along one dimension.

    Without a start and an end the window is that of the last 31 days; ``all_dates`` reads every date there is.
    """
    if start is None and end is None and not all_dates:
        start, end = last_n_days()
    report = performance_report(facts, sources, start, end, link_facts=link_facts)
    return classify(rollup(rows_of_report(report), dimension), dimension=Dimension(dimension).value)


def record_counts(rows: DataFrame, dimension: Dimension | str = Dimension.SUB_ID) -> DataFrame:
    """(original_record_count, total_records): parsed rows, and what is left of them along a dimension. Both are counted without a sort."""
    parsed = rows.agg(F.count(F.lit(1)).alias("original_record_count"))
    return parsed.withColumn("total_records", rollup(rows, dimension).select(F.count(F.lit(1))).scalar())


class Analysis:
    """All insight results of one scope. Each is computed when asked for; shared ones are frozen once."""

    def __init__(self, classified: DataFrame, vertical: str | None = None, traffic_type: str | None = None,
                 media_type: str | None = None):
        self._classified = classified
        self._scope = {"vertical": vertical, "traffic_type": traffic_type, "media_type": media_type}

    @cached_property
    def insights(self) -> Insights:
        return Insights(self._classified, **self._scope)

    @property
    def sources(self) -> DataFrame:
        return self.insights.keep().sources

    @cached_property
    def cohorts(self) -> DataFrame:
        return freeze(portfolio.cohort_intelligence(self.insights), "cohort-intelligence")

    @cached_property
    def health(self) -> DataFrame:
        return freeze(portfolio.portfolio_health(self.insights), "health")

    @cached_property
    def scenarios(self) -> DataFrame:
        return freeze(scenarios.what_if_scenarios(self.insights), "scenarios")

    @cached_property
    def alerts(self) -> DataFrame:
        return freeze(scenarios.smart_alerts(self.insights, self.cohorts, self.health), "alerts")

    def overall(self) -> DataFrame:
        return portfolio.overall_insights(self.insights.keep(), self.scenarios, self.alerts, self.health)

    def executive_facts(self) -> DataFrame:
        words = {"vertical": "Vertical", "traffic_type": "Traffic Type", "media_type": "Media Type"}
        context = ", ".join(f"{words[k]}: {v}" for k, v in self._scope.items() if v is not None)
        return portfolio.executive_facts(self.insights.keep(), self.overall(), self.health, context or "All Data")
