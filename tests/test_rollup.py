from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import source, sources
from sourcegauge.operators.rollup import Dimension, rollup
from sourcegauge.plans.registered import _rows
from sourcegauge.schema import MEASURES


@pytest.mark.parametrize("dimension", list(Dimension))
def test_sums_are_kept(spark, tables, dimension):
    rows = _rows(spark, tables)
    wanted = rows.agg(*[F.sum(m).alias(m) for m in MEASURES]).first()
    assert rollup(rows, dimension).agg(*[F.sum(m).alias(m) for m in MEASURES]).first() == wanted


def test_metadata(spark):
    rows = sources(spark, [
        source(3, "a", internal_channel=None, placement="p1", source_name="x", channel="late", media_type="", total_calls=1),
        source(1, "b", internal_channel="Standard", placement="p2", source_name="x", channel="first", media_type="m|n", total_calls=2),
        source(2, "c", internal_channel="Premium", placement="", source_name="", channel="only", media_type="m|n", total_calls=4),
    ])
    overall = {r.internal_channel: r for r in rollup(rows, "overall").collect()}
    merged = overall["Standard"]
    assert (merged.sub_id, merged.placement, merged.source_name, merged.channel, merged.total_calls, merged.ord) == (
        "Health - Full O&O Standard", "2 placements", "x", "first", 3.0, 1)
    assert (overall["Premium"].placement, overall["Premium"].source_name, overall["Premium"].media_type) == ("", "", "m|n")
    by_media = {(r.sub_id, r.internal_channel): r for r in rollup(rows, "media_type").collect()}
    assert set(by_media) == {("Unknown", "Standard"), ("m|n", "Standard"), ("m|n", "Premium")}
    assert by_media[("Unknown", "Standard")].media_type == "Unknown"
