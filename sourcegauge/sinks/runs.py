"""Runs and their results as tables of versions, of which manifests name the one that counts."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import action_stats
from ..session import delete, path_exists, publish


def result_rows(classified: DataFrame, created_at: Column) -> DataFrame:
    """Stored form of classified records."""
    none = F.lit(None)
    return classified.select(
        "sub_id", "vertical", "traffic_type",
        none.cast("int").alias("current_tier"),
        F.col("current_classification").alias("current_tier_label"),
        F.col("recommended_classification").alias("recommended_tier"),
        none.cast("int").alias("recommended_tier_num"),
        "action", "action_label", "channel", "placement", "description", "source_name",
        F.col("media_type").alias("media_type_name"),
        "campaign_type",
        F.col("total_calls").cast("bigint").alias("total_calls"),
        F.col("calls_over_threshold").cast("bigint").alias("calls_over_threshold"),
        "call_quality_rate",
        F.col("lead_volume").cast("bigint").alias("total_leads"),
        F.lit(0).cast("bigint").alias("total_clicks"),
        F.col("lead_transfer_rate").alias("lead_ctr_rate"),
        "total_revenue", "classification_reason", "premium_min", "standard_min",
        created_at.alias("created_at"),
    )


def run_header(results: DataFrame, start_date: str, end_date: str, file_name: str, created_at: Column,
               name: str | None = None) -> DataFrame:
    """One row with the counters of a run."""
    stats = action_stats(results)
    return stats.select(
        F.lit(name).cast("string").alias("name"),
        F.lit(start_date).alias("start_date"),
        F.lit(end_date).alias("end_date"),
        F.lit(file_name).alias("file_name"),
        "total_records",
        F.col("promote").alias("promote_count"),
        F.col("demote").alias("demote_count"),
        F.col("below").alias("below_min_count"),
        F.col("correct").alias("correct_count"),
        F.col("review").alias("review_count"),
        F.col("pause").alias("pause_count"),
        F.col("insufficient_volume").alias("insufficient_volume_count"),
        created_at.alias("created_at"),
        created_at.alias("updated_at"),
    )


RESULT_SCHEMA = """
    sub_id STRING, vertical STRING, traffic_type STRING, current_tier INT, current_tier_label STRING, recommended_tier STRING,
    recommended_tier_num INT, action STRING, action_label STRING, channel STRING, placement STRING, description STRING,
    source_name STRING, media_type_name STRING, campaign_type STRING, total_calls BIGINT, calls_over_threshold BIGINT,
    call_quality_rate DOUBLE, total_leads BIGINT, total_clicks BIGINT, lead_ctr_rate DOUBLE, total_revenue DOUBLE,
    classification_reason STRING, premium_min DOUBLE, standard_min DOUBLE, created_at TIMESTAMP, run_id STRING"""
RUN_SCHEMA = """
    name STRING, start_date STRING, end_date STRING, file_name STRING, total_records BIGINT, promote_count BIGINT,
    demote_count BIGINT, below_min_count BIGINT, correct_count BIGINT, review_count BIGINT, pause_count BIGINT,
    insufficient_volume_count BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP, run_id STRING"""


MANIFEST_SCHEMA = "number BIGINT, version STRING, run_id STRING"


class RunStore:
    """Runs in one folder: ``results`` and ``runs``, partitioned by run_id and version, and ``manifests``, which say what version of a run counts.

    Each write makes a version of its own and then renames a manifest into place, so readers see the old run or the new one, whole, and
    neither a failed write nor a second writer mixes files into a run. Of two writers of one run the later manifest counts. Versions that
    do not count take room until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, classified: DataFrame, start_date: str = "", end_date: str = "", file_name: str = "",
              name: str | None = None, run_id: str | None = None, created_at: dt.datetime | None = None,
              dimension: str = "sub_id") -> str:
        """Add a run, or put another version in its place.

        Only runs per sub_id are stored; rolled-up views of the same upload are not runs of their own.
        """
        if dimension != "sub_id":
            raise ValueError(f"runs are stored per sub_id, not per {dimension}")
        run_id = run_id or uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9_-]+", run_id):
            raise ValueError(f"not a run id: {run_id!r}")
        now = F.lit(created_at or dt.datetime.now(dt.timezone.utc)).cast("timestamp")
        version = uuid.uuid4().hex
        place = f"run_id={run_id}/version={version}"
        result_rows(classified, now).write.parquet(f"{self.folder}/results/{place}")
        stored = self.spark.read.schema(RESULT_SCHEMA).parquet(f"{self.folder}/results/{place}")
        run_header(stored, start_date, end_date, file_name, now, name).write.parquet(f"{self.folder}/runs/{place}")
        number = (self._manifests().where(F.col("run_id") == run_id).agg(F.max("number")).first()[0] or 0) + 1
        text = json.dumps({"number": number, "version": version})
        publish(self.spark, f"{self.folder}/manifests/run_id={run_id}/{number:09d}-{version}.json", text)
        return run_id

    def _manifests(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.folder}/manifests"):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).json(f"{self.folder}/manifests")

    def _current(self) -> DataFrame:
        """(run_id, version), one row for each run."""
        return self._manifests().groupBy("run_id").agg(F.max(F.struct("number", "version"))["version"].alias("version"))

    def _rows(self, table: str, schema: str) -> DataFrame:
        if not path_exists(self.spark, f"{self.folder}/{table}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, version STRING").parquet(f"{self.folder}/{table}")
        return rows.join(self._current(), ["run_id", "version"]).select(*[c for c in rows.columns if c != "version"])

    def runs(self) -> DataFrame:
        return self._rows("runs", RUN_SCHEMA)

    def results(self) -> DataFrame:
        """All results; a filter on run_id reads that run only."""
        return self._rows("results", RESULT_SCHEMA)

    def vacuum(self) -> int:
        """Delete versions that do not count and say how many folders went. Not to be run beside writers: a version still without manifest does not count."""
        gone = 0
        current = self._current().select("run_id", "version")
        for table, schema in (("runs", RUN_SCHEMA), ("results", RESULT_SCHEMA)):
            if not path_exists(self.spark, f"{self.folder}/{table}"):
                continue
            rows = self.spark.read.schema(f"{schema}, version STRING").parquet(f"{self.folder}/{table}")
            for r in rows.select("run_id", "version").distinct().join(current, ["run_id", "version"], "left_anti").toLocalIterator():
                delete(self.spark, f"{self.folder}/{table}/run_id={r.run_id}/version={r.version}")
                gone += 1
        return gone

    def latest(self, k: int | None = 10) -> DataFrame:
        """The newest runs; all with ``k=None``."""
        newest = self.runs().drop("updated_at").orderBy(F.col("created_at").desc())
        return newest if k is None else newest.limit(k)

    def run_with_results(self, run_id: str) -> DataFrame:
        """Header columns (prefixed with ``run_``) beside each result of one run."""
        header = self.runs().where(F.col("run_id") == run_id)
        header = header.select("run_id", *[F.col(c).alias(f"run_{c}") for c in header.columns if c != "run_id"])
        return self.results().where(F.col("run_id") == run_id).join(header, "run_id")
