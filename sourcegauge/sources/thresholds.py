"""Quality thresholds per (vertical, traffic type), with overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import NUMBER_PREFIX
from ..settings import CALL_SECONDS, THRESHOLDS

METRICS = ("call", "lead")
FIELDS = ("premium_min", "standard_min", "pause_max", "target")


def threshold_table(spark: SparkSession) -> DataFrame:
    """The fifteen default rows, as a literal relation (its exact size is known to the planner)."""

    def number(v: float | None) -> str:
        return "CAST(NULL AS DOUBLE)" if v is None else f"{v!r}D"

    rows = ", ".join(
        f"('{vertical}', '{traffic}', {str(call[0] is not None).lower()}, {CALL_SECONDS[vertical]}, "
        f"{', '.join(number(v) for v in (*call, *lead))})"
        for vertical, traffic, call, lead in THRESHOLDS
    )
    columns = ", ".join(f"{m}_{f}" for m in METRICS for f in FIELDS)
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(vertical, traffic_type, has_premium, call_seconds, {columns})"
    )


def percent_to_rate(text: Column) -> Column:
    """'12.5%' -> 0.125; NULL when the text holds no number."""
    prefix = F.regexp_extract(F.replace(text, F.lit("%"), F.lit("")), NUMBER_PREFIX, 1)
    return prefix.try_cast("double") / 100


def with_overrides(thresholds: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited values win over the defaults.

    ``edits``: vertical, traffic_type, metric, field, raw (percent text), edit_no. The latest
    readable edit of a field counts. Still one row per default pair.
    """
    readable = edits.withColumn("rate", percent_to_rate(F.col("raw"))).where("rate IS NOT NULL")

    def latest(metric: str, field: str) -> Column:
        hit = (F.col("metric") == metric) & (F.col("field") == field)
        return F.max_by(F.when(hit, F.col("rate")), F.when(hit, F.col("edit_no")))

    wide = readable.groupBy("vertical", "traffic_type").agg(
        *[latest(m, f).alias(f"new_{m}_{f}") for m in METRICS for f in FIELDS]
    )
    joined = thresholds.join(wide, ["vertical", "traffic_type"], "left")
    return joined.select(
        "vertical", "traffic_type", "has_premium", "call_seconds",
        *[F.coalesce(f"new_{m}_{f}", f"{m}_{f}").alias(f"{m}_{f}") for m in METRICS for f in FIELDS],
    )
