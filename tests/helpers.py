"""Builders of small inputs."""

from __future__ import annotations

from sourcegauge.schema import MEASURES, SOURCE_TEXTS

ROW_SCHEMA = ("ord BIGINT, sub_id STRING, vertical STRING, traffic_type STRING, internal_channel STRING, "
              + ", ".join(f"{t} STRING" for t in SOURCE_TEXTS) + ", " + ", ".join(f"{m} DOUBLE" for m in MEASURES))


def source(ord, sub_id, vertical="Health", traffic_type="Full O&O", internal_channel=None, **values):
    texts = [values.pop(t, "") for t in SOURCE_TEXTS]
    numbers = [float(values.pop(m, 0)) for m in MEASURES]
    assert not values, values
    return (ord, sub_id, vertical, traffic_type, internal_channel, *texts, *numbers)


def sources(spark, rows):
    return spark.createDataFrame(rows, ROW_SCHEMA)


INSIGHT_SCHEMA = ("ord BIGINT, sub_id STRING, vertical STRING, traffic_type STRING, media_type STRING, current_classification STRING, "
                  "action STRING, call_quality_rate DOUBLE, lead_transfer_rate DOUBLE, total_revenue DOUBLE, lead_volume DOUBLE, "
                  "total_calls DOUBLE, has_insufficient_volume BOOLEAN")


def record(ord, sub_id=None, vertical="Health", traffic_type="Full O&O", tier="Standard", action="keep_standard", call=0.1, lead=0.06,
           revenue=100.0, leads=500.0, calls=500.0, low=False, media="Search"):
    return (ord, sub_id or f"S{ord:04d}", vertical, traffic_type, media, tier, action, call, lead, float(revenue), float(leads),
            float(calls), low)


def records(spark, rows):
    return spark.createDataFrame(rows, INSIGHT_SCHEMA)
