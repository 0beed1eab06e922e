"""Running sums over very large ordered groups.

``row_number`` or ``rank`` over (group, order) sends a whole group to one task. Groups here
are cohorts, of which there are only a few, so one of them may hold most rows. Instead the
rows are cut into slices by a range partitioning on (group, order); each slice is summed on
its own and starts from the sum of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import freeze

BEFORE = "before_"
WHOLE = "whole_"


def cumulate(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], weights: Sequence[str]) -> DataFrame:
    """Add, per weight, the sum over the group's earlier rows and over the whole group.

    ``order`` must be a total order within the group. Columns added: ``before_<weight>`` and
    ``whole_<weight>``. With weight 1 per row, ``before_`` is the zero-based position.
    """
    keys = list(keys)
    # No partition number: AQE merges neighbouring ranges that are small.
    cut = rows.repartitionByRange(*keys, *order).withColumn("slice", F.spark_partition_id())
    # Written once: range bounds are sampled, so slices must not be computed twice.
    cut = freeze(cut, "slices")
    per_slice = cut.groupBy(*keys, "slice").agg(*[F.sum(w).alias(w) for w in weights])
    # At most (slices + groups) rows from here to the join.
    group = W.partitionBy(*keys)
    earlier = group.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = per_slice.select(
        *keys, "slice",
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"start_{w}") for w in weights],
        *[F.sum(w).over(group).alias(WHOLE + w) for w in weights],
    )
    in_slice = W.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    running = {
        BEFORE + w: F.col(f"start_{w}") + F.coalesce(F.sum(w).over(in_slice), F.lit(0)) for w in weights
    }
    return cut.join(starts, [*keys, "slice"]).withColumns(running).drop("slice", *[f"start_{w}" for w in weights])


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Zero-based ``position`` of each row in its group and the group's ``group_size``."""
    counted = cumulate(rows.withColumn("one", F.lit(1)), keys, order, ["one"])
    return counted.withColumnsRenamed({BEFORE + "one": "position", WHOLE + "one": "group_size"}).drop("one")


def middle(value: Column, before: Column, weight: Column, whole: Column) -> Column:
    """Aggregate: exact median of distinct values with their counts and running counts."""

    def at(place: Column) -> Column:
        return F.max(F.when((before <= place) & (place < before + weight), value))

    return (at(F.floor((whole - 1) / 2)) + at(F.floor(whole / 2))) / 2
