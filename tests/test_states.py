"""Reports from daily states against reports from facts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sourcegauge.operators.report import performance_report
from sourcegauge.sinks.states import DailyStates

DAY = dt.date(2024, 3, 1)
SCHEMA = ("sub_id STRING, vertical STRING, session_id BIGINT, date_platform DATE, transaction_type STRING, call_category STRING, call_transfers INT, "
          "paid_calls INT, call_duration DOUBLE, clicks INT, placement STRING, channel STRING, revenue DOUBLE")


def _facts(spark):
    """Sessions whose leads and calls lie days apart, repeated leads, days without a date, missing values and unknown sources."""
    rows = []
    for i in range(600):
        kind = ("Lead", "Call", "Call", "Click", "Redirect")[i % 5]
        call = kind == "Call"
        rows.append((None if i % 97 == 0 else ("", "unknown", "A", "B", "C")[i % 7 % 5], ("Health", "Auto", "Pet")[i % 11 % 3], None if i % 13 == 0 else i % 17,
                     None if i % 29 == 0 else DAY + dt.timedelta(days=i * 7 % 40), kind, "Outbound" if call and i % 3 else None, int(call), int(call and i % 2),
                     float(i) if call else None, i % 4 if kind == "Click" else None, None if i % 19 == 0 else f"p{i % 6}", f"c{i % 3}", None if i % 23 == 0 else float(i % 50)))
    return spark.createDataFrame(rows, SCHEMA)


def _dimension(spark):
    rows = [("A", 1, "d", "x", "Full O&O", "Health", "s", "m", "t", DAY), ("B", None, "d", "x", "Non O&O", "Auto", "s", "m", "t", DAY)]
    return spark.createDataFrame(rows, "subid STRING, tier INT, description STRING, channel STRING, traffic_type STRING, vertical_name STRING, "
                                       "source_name STRING, media_type_name STRING, campaign_type STRING, snapshot_date DATE")


@pytest.mark.parametrize("start, end", [(None, None), (3, 33), (0, 0), (35, 90), (None, 5), (200, 210)])
@pytest.mark.parametrize("dedupe", [False, True])
def test_a_window_from_states_is_that_of_its_facts(spark, tmp_path_factory, start, end, dedupe):
    folder = tmp_path_factory.getbasetemp() / "states"
    facts, dimension = _facts(spark), _dimension(spark)
    states = DailyStates(spark, str(folder))
    if not folder.exists():
        states.add(facts)
    days = [None if n is None else DAY + dt.timedelta(days=n) for n in (start, end)]
    wanted = performance_report(facts, dimension, *days, dedupe_sessions=dedupe)
    got = states.report(dimension, *days, dedupe_sessions=dedupe)
    assert got.dtypes == wanted.dtypes and sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_days_are_replaced(spark, tmp_path):
    facts, dimension = _facts(spark), _dimension(spark)
    states = DailyStates(spark, str(tmp_path))
    with pytest.raises(ValueError):
        states.report(dimension)
    for first in (20, 0):  # in any order
        states.add(facts, DAY + dt.timedelta(days=first), DAY + dt.timedelta(days=first + 19))
    dated = facts.where("date_platform IS NOT NULL")
    same = lambda f: sorted(map(str, performance_report(f, dimension).collect()))
    assert sorted(map(str, states.report(dimension).collect())) == same(dated)
    changed = dated.where(F.col("date_platform") != DAY + dt.timedelta(days=7)).withColumn("revenue", F.col("revenue") + 1)
    states.add(changed, DAY, DAY + dt.timedelta(days=39))
    assert sorted(map(str, states.report(dimension).collect())) == same(changed)
    assert states.days().count() == changed.where("sub_id IN ('A', 'B', 'C') AND vertical <> 'Pet'").select("date_platform").distinct().count()


def test_only_the_days_of_a_window_are_read(spark, tmp_path):
    states = DailyStates(spark, str(tmp_path))
    states.add(_facts(spark))
    plan = states.direct(DAY, DAY + dt.timedelta(days=3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state_day" in plan
