"""Append-only table of decisions, partitioned by day."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.decisions import DAY, HISTORY_COLUMNS, valid_decisions
from ..session import freeze, path_exists, publish
from .textindex import TextIndex, file_name

SCHEMA = """
    sub_id STRING, vertical STRING, traffic_type STRING, media_type STRING, action_taken STRING, action_label STRING, previous_state STRING,
    new_state STRING, metric_mode STRING, call_quality DOUBLE, lead_quality DOUBLE, total_revenue DOUBLE, notes STRING, taken_by STRING,
    created_at TIMESTAMP, created_day DATE"""


#: Which batch a record came with, and its name inside the batch.
_ORIGIN = ", batch_id STRING, decision_id STRING"
#: Columns that a search for text looks into.
SEARCHED = ("sub_id", "notes")


class HistoryStore:
    """Days are folders; ``_batches`` beside them holds a small file for each batch that was begun, and one for each that is complete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.texts = TextIndex(spark, f"{self.folder}/_texts")

    def append(self, decisions: DataFrame, batch_id: str | None = None) -> bool:
        """Add decisions; False if the batch is there already.

        With a ``batch_id`` the same batch may be appended again, after success or after any failure, and each of its decisions is there once.
        Equal decisions of a batch are told apart by number. Records without a time get that of the batch's first attempt.
        """
        retry = False
        now = dt.datetime.now(dt.timezone.utc)
        batch = batch_id or uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        begun, complete = f"{self.folder}/_batches/{batch}.begun", f"{self.folder}/_batches/{batch}.complete"
        if batch_id is not None:
            if path_exists(self.spark, complete):
                return False
            if retry := path_exists(self.spark, begun):
                now = dt.datetime.fromisoformat(self.spark.read.text(begun).first()[0])
            else:
                publish(self.spark, begun, now.isoformat())
        rows = valid_decisions(decisions, F.lit(now).cast("timestamp")).withColumn(DAY, F.to_date("created_at"))
        content = F.sha2(F.to_json(F.struct(*HISTORY_COLUMNS)), 256)
        if batch_id is not None:
            rows = rows.withColumn("content", content)
            number = F.row_number().over(W.partitionBy("content").orderBy("content"))
            rows = rows.withColumn("decision_id", F.concat_ws("-", "content", number)).drop("content")
        else:
            rows = rows.withColumn("decision_id", F.lit(None).cast("string"))
        rows = rows.withColumn("batch_id", F.lit(batch if batch_id is not None else None).cast("string"))
        if retry:
            # Of what the failed attempt left, only the days that the batch touches are read.
            rows = freeze(rows, "batch")
            days = [r[0] for r in rows.select(DAY).distinct().collect()]
            there = self._stored().where(F.col(DAY).isin(days) & (F.col("batch_id") == batch)).select("decision_id")
            rows = rows.join(there, "decision_id", "left_anti")
        self._write(rows.select(*HISTORY_COLUMNS, "batch_id", "decision_id", DAY), "append")
        if batch_id is not None:
            publish(self.spark, complete, now.isoformat())
        return True

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Gathers the rows of a day into few files; AQE splits a day that is too large for a task.
        rows.hint("rebalance", DAY).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.folder)

    def _stored(self) -> DataFrame:
        if not path_exists(self.spark, self.folder):
            return self.spark.createDataFrame([], SCHEMA + _ORIGIN)
        return self.spark.read.schema(SCHEMA + _ORIGIN).parquet(self.folder)

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA + _ORIGIN).option("basePath", self.folder).parquet(*[unquote(p) for p in paths])

    def read(self, text: str | None = None) -> DataFrame:
        """All records; a range of created_day prunes whole days. A store without data is empty.

        With a text, files that cannot hold it in a searched column, by their bitmaps, are left out; all records that do hold it are there.
        Files that ``index_texts`` has not seen yet are read.
        """
        rows = self._stored()
        if text and (out := self.texts.ruled_out(text)):
            there = rows.inputFiles()
            kept = [p for p in there if file_name(p) not in out]
            rows = rows.limit(0) if not kept else rows if len(kept) == len(there) else self._files(kept)
        return rows.drop("batch_id", "decision_id")

    def index_texts(self) -> int:
        """Make bitmaps for the files that have none, and say how many those were. To be run after appends and compaction; a failed run adds nothing."""
        known = self.texts.indexed()
        new = [p for p in self._stored().inputFiles() if file_name(p) not in known]
        if new:
            self.texts.add(self._files(new), new, SEARCHED)
        return len(new)

    def compact(self, before: dt.date | None = None, most: int = 4) -> int:
        """Write days (before a date) that have more than ``most`` files anew in few files, and say how many days that were.

        Rows are copied to the shared folder before any day is replaced. Not to be run beside appends to, or readers of, these days.
        """
        rows = self._stored()
        if before is not None:
            rows = rows.where(F.col(DAY) < F.lit(before))
        files = rows.groupBy(DAY, F.col("_metadata.file_path").alias("file")).agg(F.lit(1).alias("one")) if rows.inputFiles() else rows.limit(0).withColumn("one", F.lit(1))
        days = [r[0] for r in files.groupBy(DAY).agg(F.sum("one").alias("n")).where(F.col("n") > most).collect()]
        if days:
            self._write(freeze(rows.where(F.col(DAY).isin(days)), "compacted-days"), "overwrite")
        return len(days)
