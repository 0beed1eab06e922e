"""Reports from bucketed facts against reports from plain ones, and the link's plan."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from sourcegauge.operators.report import direct_metrics, performance_report
from sourcegauge.sinks.facts import FactStore
from tests.test_plans import plan
from tests.test_states import DAY, _dimension
from tests.test_states import _facts as _daily


def _facts(spark):
    """As those of the states, on four days and without one: each day costs files."""
    since = F.datediff("date_platform", F.lit(DAY))
    return _daily(spark).withColumn("date_platform", F.date_add(F.lit(DAY), F.floor(since / 10).cast("int") * 10))


def _store(spark, folder, batches, **options):
    store = FactStore(spark, f"facts_{uuid.uuid4().hex}", str(folder), **options)
    for batch in batches:
        store.add(batch)
    return store


def _halves(facts):
    late = F.coalesce(F.col("date_platform") >= F.lit(DAY + dt.timedelta(days=20)), F.lit(False))
    return facts.where(~late), facts.where(late)


@pytest.mark.parametrize("hot_rows, dedupe", [(0, True), (17, False), (17, True), (10_000, False)])
def test_report_equals_that_of_plain_facts(spark, tmp_path, dedupe, hot_rows):
    """Whichever rows lie in buckets: none, sessions that are loose in one batch alone, all."""
    facts, dimension = _facts(spark), _dimension(spark)
    store = _store(spark, tmp_path, _halves(facts), buckets=3, hot_rows=hot_rows)
    assert store._all().count() == facts.count()
    for days in ((None, None), (DAY + dt.timedelta(days=3), DAY + dt.timedelta(days=25))):
        wanted = performance_report(facts, dimension, *days, dedupe_sessions=dedupe)
        assert sorted(map(str, store.report(dimension, *days, dedupe_sessions=dedupe).collect())) == sorted(map(str, wanted.collect()))
    store.drop()


def test_facts_are_not_shuffled_for_the_link(spark, tmp_path):
    store = _store(spark, tmp_path, [_facts(spark)], buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for dedupe in (False, True):
            text = plan(store.met_in_buckets(DAY, DAY + dt.timedelta(days=30), dedupe))
            assert text.count("Exchange") == 1 and "hashpartitioning(sub_id" in text and "hashpartitioning(session_id" not in text
            assert text.count("SelectedBucketsCount: 4 out of 4") == 2 and text.count("PartitionFilters: [isnotnull(date_platform") == 2
        # A source may own a large part of the facts: its metrics are summed before they are shuffled.
        text = plan(direct_metrics(store.facts()))
        assert text.count("Exchange") == 2 and "partial_sum" in text.split("Exchange")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        store.drop()


def test_a_day_is_added_once(spark, tmp_path):
    facts = _facts(spark)
    early, late = _halves(facts)
    store = _store(spark, tmp_path, [early])
    with pytest.raises(ValueError, match="already"):
        store.add(facts)
    with pytest.raises(ValueError, match="already"):
        store.add(facts.where("date_platform IS NULL"))
    assert store._all().count() == early.count()
    store.add(late)
    assert store._all().count() == facts.count()
    store.drop()
