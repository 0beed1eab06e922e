"""Facts laid out for the session link: rows of one session lie in one bucket, so that leads meet calls without a shuffle.

Two tables of the session's catalog, both partitioned by day. The first is bucketed by session. A bucket is read by one task, so rows of
sessions with more than ``hot_rows`` facts in a batch, and rows without a session, are kept in the second, loose one. A session may have rows in
both: what meets across them is joined as well, by the few sessions of the loose table.

Nothing is bucketed by source: a source may own a large part of the facts, and direct metrics are summed in each task before they are shuffled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import direct_metrics, report_of, session_calls, session_leads
from ..session import freeze
from ..sources.warehouse import in_window, named_sources

DAY = "date_platform"
#: Facts of one session in one batch beyond which they are not put into one bucket.
HOT_ROWS = 1_000_000


class FactStore:
    """Facts in the tables ``name`` and ``name``_loose below ``folder``. Batches add days; a day can be added once.

    ``buckets``: about the bytes of a usual window over what one task should read; the shuffle partitions if not given.
    The catalog keeps the layout, so a store outlives its session where the catalog does.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int | None = None, hot_rows: int = HOT_ROWS):
        self.spark, self.name, self.folder, self.hot_rows = spark, name, folder.rstrip("/"), hot_rows
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def add(self, facts: DataFrame) -> None:
        """Append the facts of days that are not there yet; ValueError, and nothing written, if one is."""
        facts = facts.withColumn(DAY, F.col(DAY).cast("date"))
        if self.spark.catalog.tableExists(self.name):
            stored = self._all().select(DAY).distinct()
            again = facts.select(DAY).distinct().join(stored.withColumnRenamed(DAY, "day"), F.col(DAY).eqNullSafe(F.col("day")), "left_semi")
            if found := again.first():
                raise ValueError(f"day {found[0]} is in {self.name} already")
        hot = facts.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.hot_rows)
        hot = freeze(hot.select("session_id"), "hot-sessions")
        usual = facts.where(F.col("session_id").isNotNull()).join(hot, "session_id", "left_anti")
        loose = facts.where(F.col("session_id").isNull()).unionByName(facts.join(hot, "session_id", "left_semi").select(facts.columns))
        # The writer's hash is that of the exchange: each task writes one bucket, a file for each day.
        usual.select(facts.columns).repartition(self.buckets, "session_id").write.mode("append").partitionBy(DAY).bucketBy(self.buckets, "session_id").option(
            "path", f"{self.folder}/usual").saveAsTable(self.name)
        loose.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).option("path", f"{self.folder}/loose").saveAsTable(self._loose)

    @property
    def _loose(self) -> str:
        return f"{self.name}_loose"

    def _all(self) -> DataFrame:
        return self.spark.table(self.name).unionByName(self.spark.table(self._loose))

    def facts(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """Facts of named sources in a window; only its days are read."""
        return named_sources(in_window(self._all(), start, end))

    def met_in_buckets(self, start: dt.date | None = None, end: dt.date | None = None, dedupe_sessions: bool = False) -> DataFrame:
        """(sub_id, vertical, credited) of leads and calls that both lie in buckets. Facts are not shuffled."""
        usual = named_sources(in_window(self.spark.table(self.name), start, end))
        leads, calls = session_leads(usual), session_calls(usual).select("session_id", "transfers")
        met = (leads.distinct() if dedupe_sessions else leads).join(calls, "session_id")
        return met.groupBy("sub_id", "vertical").agg(F.sum("transfers").alias("credited"))

    def outbound(self, start: dt.date | None = None, end: dt.date | None = None, dedupe_sessions: bool = False) -> DataFrame:
        """Transfers credited to the sources that own a lead of the same session, for sources that have any."""
        usual, loose = (named_sources(in_window(self.spark.table(t), start, end)) for t in (self.name, self._loose))
        sessions = freeze(loose.where(F.col("session_id").isNotNull()).select("session_id").distinct(), "loose-sessions")
        near = usual.join(sessions, "session_id", "left_semi")
        columns = ("session_id", "transfers")
        loose_calls = freeze(session_calls(loose).select(*columns), "loose-calls")
        both_calls = freeze(session_calls(near).select(*columns).unionByName(loose_calls).groupBy("session_id").agg(F.sum("transfers").alias("transfers")), "both-calls")
        leads, loose_leads = session_leads(near), session_leads(loose)
        if dedupe_sessions:
            leads = leads.distinct()
            loose_leads = loose_leads.distinct().join(leads, ["sub_id", "vertical", "session_id"], "left_anti")
        across = leads.join(loose_calls, "session_id").unionByName(loose_leads.join(both_calls, "session_id"))
        across = across.groupBy("sub_id", "vertical").agg(F.sum("transfers").alias("credited"))
        every = self.met_in_buckets(start, end, dedupe_sessions).unionByName(across)
        return every.groupBy("sub_id", "vertical").agg(F.sum("credited").alias("credited"))

    def report(self, dimension: DataFrame, start: dt.date | None = None, end: dt.date | None = None, dedupe_sessions: bool = False) -> DataFrame:
        """The performance report of a window, equal to the one made from facts that are not laid out."""
        return report_of(direct_metrics(self.facts(start, end)), self.outbound(start, end, dedupe_sessions), dimension)

    def drop(self) -> None:
        """Forget both tables; their files stay."""
        for table in (self.name, self._loose):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
