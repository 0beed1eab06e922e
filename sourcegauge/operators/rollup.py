"""Re-aggregation of source rows along one business dimension."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MEASURES, ORD, SOURCE_ROW


class Dimension(str, Enum):
    SUB_ID = "sub_id"
    SOURCE_NAME = "source_name"
    PLACEMENT = "placement"
    MEDIA_TYPE = "media_type"
    OVERALL = "overall"


# Column -> word used when a group holds several values.
SEVERAL = {
    "placement": "placements",
    "description": "descriptions",
    "source_name": "sources",
    "media_type": "types",
    "campaign_type": "types",
}


def _filled(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def rollup(rows: DataFrame, dimension: Dimension | str) -> DataFrame:
    """Source rows per (dimension value, vertical, traffic type, channel).

    ``sub_id`` passes rows through. Sums combine on the map side; the descriptive columns are
    made distinct by (group, column, value) first, so a large group spreads over its values.
    """
    dimension = Dimension(dimension)
    if dimension is Dimension.SUB_ID:
        return rows
    keys = {"vertical": F.col("vertical"), "traffic_type": F.col("traffic_type"),
            "channel_group": _filled("internal_channel", "Standard")}
    own = None
    if dimension is not Dimension.OVERALL:
        own = dimension.value
        keys = {"group_value": _filled(own, "Unknown"), **keys}

    def filled_or_null(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    described = [c for c in SEVERAL if c != own]
    keyed = rows.withColumns({f"by_{name}": c for name, c in keys.items()})
    by = [f"by_{name}" for name in keys]
    # Numbers alone, so that they are summed in hash maps; texts and order apart from them, in narrow rows.
    sums = keyed.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MEASURES])
    first = keyed.groupBy(*by).agg(F.min(ORD).alias(ORD), F.min_by("channel", ORD).alias("channel"))
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), filled_or_null(c).alias("value")) for c in described])
    values = keyed.select(*by, F.inline(cells)).where("value IS NOT NULL").distinct()
    texts = values.groupBy(*by).agg(
        *[F.count_if(F.col("cell") == c).alias(f"n_{c}") for c in described],
        *[F.min(F.when(F.col("cell") == c, F.col("value"))).alias(f"one_{c}") for c in described],
    )
    grouped = sums.join(first, by).join(texts, by, "left").withColumnsRenamed({f"by_{name}": name for name in keys})
    name = F.col("group_value") if own else F.concat(
        "vertical", F.lit(" - "), "traffic_type", F.lit(" "), "channel_group")
    texts = {
        c: F.when(F.col(f"n_{c}") > 1, F.concat(F.col(f"n_{c}").cast("string"), F.lit(f" {SEVERAL[c]}")))
        .otherwise(F.coalesce(f"one_{c}", F.lit("")))
        for c in described
    }
    if own:
        texts[own] = F.col("group_value")
    return grouped.withColumns({**texts, "sub_id": name, "internal_channel": F.col("channel_group")}).select(*SOURCE_ROW)
