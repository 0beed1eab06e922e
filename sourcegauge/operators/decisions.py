"""Human decisions: records made from recommendations, and searches in their history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import pick
from ..settings import DEMOTE, PAUSE, PROMOTE, WARN
from .views import distinct_values

# Codes, labels and resulting states of logged decisions.
LOG_CODES = {
    **dict.fromkeys(PROMOTE, "promote"),
    **dict.fromkeys(DEMOTE, "demote"),
    **dict.fromkeys(PAUSE, "pause"),
    **dict.fromkeys(WARN, "below"),
}
LOG_LABELS = {
    "promote": "Promoted to Premium",
    "demote": "Demoted to Standard",
    "pause": "PAUSED",
    "below": "Flagged Below MIN",
    "correct": "Maintained Current",
}
NEW_STATES = {"promote": "Premium", "demote": "Standard", "pause": "PAUSED"}

#: Partition column of a store of decisions.
DAY = "created_day"
HISTORY_COLUMNS = (
    "sub_id", "vertical", "traffic_type", "media_type", "action_taken", "action_label", "previous_state", "new_state",
    "metric_mode", "call_quality", "lead_quality", "total_revenue", "notes", "taken_by", "created_at",
)


def log_code(action: Column) -> Column:
    """Code that a recommendation is logged under; keeping things as they are is 'correct'."""
    return pick(action, LOG_CODES, "correct")


def decisions_from(view: DataFrame, action_taken: Column | None = None, metric_mode: str = "both",
                   notes: Column | None = None, taken_by: Column | None = None, created_at: Column | None = None) -> DataFrame:
    """Decision records for every row of a view; by default the recommended ones."""
    taken = log_code(F.col("action")) if action_taken is None else action_taken
    none = F.lit(None).cast("string")
    return view.withColumn("action_taken", taken).select(
        "sub_id", "vertical", "traffic_type",
        F.nullif("media_type", F.lit("")).alias("media_type"),
        "action_taken",
        pick(F.col("action_taken"), LOG_LABELS, "Reviewed").alias("action_label"),
        F.col("current_classification").alias("previous_state"),
        F.coalesce(pick(F.col("action_taken"), NEW_STATES), F.col("current_classification")).alias("new_state"),
        F.lit(metric_mode).alias("metric_mode"),
        F.col("call_quality_rate").alias("call_quality"),
        F.col("lead_transfer_rate").alias("lead_quality"),
        "total_revenue",
        F.nullif(none if notes is None else notes, F.lit("")).alias("notes"),
        F.nullif(none if taken_by is None else taken_by, F.lit("")).alias("taken_by"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def valid_decisions(decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """Records with a sub_id and an action; other fields get their defaults, ``now`` that of the time."""

    def missing(column: str) -> Column:
        return F.coalesce(column, F.lit("")) == ""

    return decisions.where(~missing("sub_id") & ~missing("action_taken")).withColumns({
        "vertical": F.coalesce("vertical", F.lit("")),
        "traffic_type": F.coalesce("traffic_type", F.lit("")),
        "media_type": F.nullif("media_type", F.lit("")),
        "action_label": F.when(missing("action_label"), F.col("action_taken")).otherwise(F.col("action_label")),
        "created_at": F.coalesce("created_at", F.current_timestamp() if now is None else now),
    }).select(*HISTORY_COLUMNS)


def latest_decisions(history: DataFrame, sub_id: str | None = None, limit: int | None = 50, ties: tuple[str, ...] = ()) -> DataFrame:
    """Newest records of one source or of all; no limit with None."""
    kept = history if sub_id is None else history.where(F.col("sub_id") == sub_id)
    newest = kept.orderBy(F.col("created_at").desc(), *ties)
    return newest if limit is None else newest.limit(limit)


def search_history(
    history: DataFrame,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    vertical: str | None = None,
    traffic_type: str | None = None,
    media_type: str | None = None,
    person: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Records that meet all given conditions; both dates are included. Of a store only the days between are read."""
    by_day = DAY in history.columns
    wanted = {"vertical": vertical, "traffic_type": traffic_type, "media_type": media_type, "taken_by": person}
    for column, value in wanted.items():
        if value:
            history = history.where(F.col(column) == value)
    if by_day and date_from is not None:
        history = history.where(F.col(DAY) >= F.lit(date_from))
    if by_day and date_to is not None:
        history = history.where(F.col(DAY) <= F.lit(date_to))
    if date_from is not None:
        history = history.where(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        history = history.where(F.col("created_at") < F.lit(date_to + dt.timedelta(days=1)).cast("timestamp"))
    if text:
        needle = F.lower(F.lit(text))
        history = history.where(F.contains(F.lower("sub_id"), needle)
                                | F.coalesce(F.contains(F.lower("notes"), needle), F.lit(False)))
    return history


def sorted_history(history: DataFrame, field: str = "created_at", direction: str = "desc", ties: tuple[str, ...] = ()) -> DataFrame:
    """By time or by revenue (missing revenue counts as 0)."""
    key = F.col("created_at") if field == "created_at" else F.coalesce("total_revenue", F.lit(0.0))
    return history.orderBy(key.desc() if direction == "desc" else key.asc(), *ties)


def filter_options(history: DataFrame) -> dict[str, DataFrame]:
    """Sorted values to choose from."""
    return {c: distinct_values(history, c) for c in ("vertical", "traffic_type", "media_type", "taken_by")}


