"""Scans of the transaction facts and the snapshotted source dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import VERTICALS

DIMENSION_COLUMNS = (
    "subid", "tier", "description", "channel", "traffic_type", "vertical_name", "source_name",
    "media_type_name", "campaign_type",
)


def last_n_days(n: int = 31, today: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Window of ``n`` days that ends yesterday, both ends included."""
    today = today or dt.date.today()
    return today - dt.timedelta(days=n), today - dt.timedelta(days=1)


def in_window(facts: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Facts of the known verticals between two dates (both included; None: open)."""
    kept = facts.where(F.col("vertical").isin(*VERTICALS))
    if start is not None:
        kept = kept.where(F.col("date_platform") >= F.lit(start))
    if end is not None:
        kept = kept.where(F.col("date_platform") <= F.lit(end))
    return kept


def named_sources(df: DataFrame) -> DataFrame:
    """Drop rows whose sub_id is missing, empty or 'unknown'."""
    return df.where(F.col("sub_id").isNotNull() & (F.col("sub_id") != "") & (F.lower("sub_id") != "unknown"))


def latest_snapshot(dimension: DataFrame) -> DataFrame:
    """Rows of the newest snapshot_date of the source dimension."""
    newest = dimension.select(F.max("snapshot_date")).scalar()
    return dimension.where(F.col("snapshot_date") == newest).select(*DIMENSION_COLUMNS)
