from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helpers import record, records
from sourcegauge.operators.cohorts import cohort_profile, percentile_at, portfolio_medians
from sourcegauge.operators.ordering import positions


def skewed(n=2000, seed=3):
    """One cohort and one value hold a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        vertical = "Health" if hot else rng.choice(["Auto", "Home", "Life"])
        rate = None if rng.random() < 0.1 else (0.0 if rng.random() < 0.4 else round(rng.random(), 2))
        rows.append(record(i, vertical=vertical, traffic_type=rng.choice(["Full O&O", "Non O&O"]), call=rate, lead=rng.choice([None, 0.1, 0.2]),
                           tier=rng.choice(["Premium", "Standard", "Standard"]), revenue=0 if rng.random() < 0.35 else rng.randrange(500)))
    return rows


@pytest.mark.parametrize("keys", [["vertical"], []])
@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_equal_row_number(spark, keys, partitions):
    df = records(spark, skewed()).repartition(partitions)
    order = [F.col("total_revenue").desc(), F.col("ord").asc()]
    plain = df.withColumn("wanted", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    placed = positions(df.select("ord", "vertical", "total_revenue"), keys, order)
    both = placed.join(plain.select("ord", "wanted"), "ord")
    assert both.count() == 2000 and both.where("position <> wanted").count() == 0


def test_cohort_profile_against_loops(spark):
    rows = skewed()
    df = records(spark, rows)
    profile = cohort_profile(df)
    got = df.join(profile, ["vertical", "traffic_type"]).select(
        "ord", *[percentile_at(F.col(f"steps_{m}"), F.col(c)).alias(m)
                 for m, c in (("call", "call_quality_rate"), ("lead", "lead_transfer_rate"), ("revenue", "total_revenue"))],
        "median_premium", "median_other", "peers").collect()
    cohorts = {}
    for r in rows:
        cohorts.setdefault((r[2], r[3]), []).append(r)
    by_ord = {g.ord: g for g in got}
    assert len(by_ord) == len(rows)
    for members in cohorts.values():
        for name, i in (("call", 7), ("lead", 8), ("revenue", 9)):
            known = [m[i] for m in members if m[i] is not None]
            for m in members:
                wanted = None if m[i] is None else int(sum(v < m[i] for v in known) / len(known) * 100 + 0.5)
                assert by_ord[m[0]][name] == wanted
        for m in members:
            assert by_ord[m[0]].median_premium == statistics.median(x[9] for x in members if x[5] == "Premium")
            assert by_ord[m[0]].median_other == statistics.median(x[9] for x in members if x[5] != "Premium")
            assert by_ord[m[0]].peers == len(members)
    both = portfolio_medians(df).first()
    assert both.median_premium == statistics.median(r[9] for r in rows if r[5] == "Premium")
    assert both.median_other == statistics.median(r[9] for r in rows if r[5] != "Premium")


def test_medians_without_one_side(spark):
    row = portfolio_medians(records(spark, [record(1, revenue=4), record(2, revenue=6)])).first()
    assert (row.median_premium, row.median_other) == (None, 5.0)
