"""Facts of each day summed once, so that a report over many days merges states instead of reading facts again.

Three tables, partitioned by day: sums per (source, placement, channel) with the highest single revenue, leads per source and session, and
outbound calls per session. All of them add up over days, and the best placement is that of the highest of the days' best, so
any window's report equals the one made from its facts. A session's leads and calls may lie on different days of the window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import MEASURED, metric_parts, metrics_of, report_of, session_calls, session_leads
from ..session import delete, freeze, path_exists
from ..settings import CALL_SECONDS
from ..sources.warehouse import in_window, named_sources

DAY = "state_day"
_CALLS = ("transfers", "paid", *(f"over_{s}" for s in sorted(set(CALL_SECONDS.values()))))


class DailyStates:
    """States in one folder. Days can be added in any order; a day that is added again is replaced."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, facts: DataFrame, start: dt.date | None = None, end: dt.date | None = None, link_facts: DataFrame | None = None) -> None:
        """Sum the facts of the days from ``start`` to ``end`` (both included; None: all there are, with those without a date as a day of their own).

        Rows of one task are summed before they are shuffled, and each day's rows are gathered into few files. Days between both
        dates that have no facts any more lose their states.
        """
        rows = named_sources(in_window(facts, start, end)).withColumn(DAY, F.col("date_platform").cast("date"))
        links = rows if link_facts is None else named_sources(in_window(link_facts, start, end)).withColumn(DAY, F.col("date_platform").cast("date"))
        tables = {
            "parts": metric_parts(rows, DAY),
            "leads": session_leads(links, DAY).groupBy("sub_id", "vertical", "session_id", DAY).agg(F.count(F.lit(1)).alias("leads")),
            "calls": session_calls(links, DAY),
        }
        if start is not None and end is not None:
            for n in range((end - start).days + 1):
                for name in tables:
                    delete(self.spark, f"{self.folder}/{name}/{DAY}={start + dt.timedelta(days=n)}")
        for name, table in tables.items():
            table.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{self.folder}/{name}")

    def _read(self, name: str, start: dt.date | None, end: dt.date | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        if start is not None:
            rows = rows.where(F.col(DAY) >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col(DAY) <= F.lit(end))
        return rows

    def days(self) -> DataFrame:
        """The days that have states."""
        return self._read("parts", None, None).select(DAY).distinct()

    def direct(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """Direct metrics of a window. Only its days are read."""
        parts = self._read("parts", start, end).groupBy("sub_id", "vertical", "placement", "channel")
        return metrics_of(parts.agg(F.max("best").alias("best"), *[F.sum(m).alias(m) for m in MEASURED]))

    def outbound(self, start: dt.date | None = None, end: dt.date | None = None, dedupe_sessions: bool = False) -> DataFrame:
        """Transfers credited to the sources that own a lead of the same session, for sources that have any."""
        leads = self._read("leads", start, end)
        if dedupe_sessions:
            leads = leads.select("sub_id", "vertical", "session_id").distinct().withColumn("leads", F.lit(1))
        calls = self._read("calls", start, end).groupBy("session_id").agg(*[F.sum(c).alias(c) for c in _CALLS])
        calls = freeze(calls.select("session_id", "transfers"), "session-calls")
        return leads.join(calls, "session_id").groupBy("sub_id", "vertical").agg(F.sum(F.col("transfers") * F.col("leads")).alias("credited"))

    def report(self, dimension: DataFrame, start: dt.date | None = None, end: dt.date | None = None, dedupe_sessions: bool = False) -> DataFrame:
        """The performance report of a window, equal to the one made from facts."""
        if not path_exists(self.spark, f"{self.folder}/parts"):
            raise ValueError(f"no states in {self.folder}")
        return report_of(self.direct(start, end), self.outbound(start, end, dedupe_sessions), dimension)
