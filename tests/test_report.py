from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from sourcegauge.operators.report import direct_metrics, outbound_on_leads, performance_report, sorted_report
from sourcegauge.plans.pipelines import classify_facts
from sourcegauge.sources.warehouse import in_window, last_n_days, latest_snapshot

FACT_SCHEMA = ("sub_id STRING, vertical STRING, session_id BIGINT, date_platform DATE, transaction_type STRING, call_category STRING, "
               "call_transfers INT, paid_calls INT, call_duration DOUBLE, clicks INT, placement STRING, channel STRING, revenue DOUBLE")
DIM_SCHEMA = ("subid STRING, tier INT, description STRING, channel STRING, traffic_type STRING, vertical_name STRING, source_name STRING, "
              "media_type_name STRING, campaign_type STRING, snapshot_date DATE")
DAY = dt.date(2024, 1, 10)
LIMIT = {"Medicare": 2700, "Life": 2100, "Health": 1200, "Auto": 1200, "Home": 1200}


def fact(sub_id="a", vertical="Health", session=None, kind="Lead", category=None, transfers=0, paid=0, duration=None, clicks=0,
         placement="p", channel="c", revenue=0.0, day=DAY):
    return (sub_id, vertical, session, day, kind, category, transfers, paid, duration, clicks, placement, channel, revenue)


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT_SCHEMA)


def dimension(spark, *rows):
    return spark.createDataFrame(list(rows), DIM_SCHEMA)


def random_facts(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        kind = rng.choice(["Lead", "Lead", "Call", "Click", "Redirect"])
        # A third of all rows share one session.
        session = rng.choice([None, 0, 0, *range(1, 40)]) if rng.random() < 0.7 else 0
        rows.append(fact(rng.choice("abcde"), rng.choice(list(LIMIT)), session, kind, rng.choice(["Outbound", "Inbound"]) if kind == "Call" else None,
                         rng.choice([0, 1, 2]), rng.choice([0, 1]), rng.choice([None, 100.0, 1200.0, 2100.0, 2700.0]), 1, revenue=float(rng.randrange(9))))
    return rows


@pytest.mark.parametrize("dedupe", [False, True])
def test_session_link_against_loops(spark, dedupe):
    rows = random_facts()
    leads = [(r[0], r[1], r[2]) for r in rows if r[4] == "Lead" and r[2] is not None]
    calls = defaultdict(list)
    for r in rows:
        if r[4] == "Call" and r[5] == "Outbound" and r[2] is not None:
            calls[r[2]].append(r)
    sessions = defaultdict(set)
    moved, paid, over = Counter(), Counter(), Counter()
    for sub_id, vertical, session in leads:
        sessions[sub_id, vertical].add(session)
    for sub_id, vertical, session in (set(leads) if dedupe else leads):
        for c in calls[session]:
            moved[sub_id, vertical] += c[6]
            paid[sub_id, vertical] += c[7]
            over[sub_id, vertical] += c[6] if (c[8] or 0) >= LIMIT[vertical] else 0
    found = {(r.sub_id, r.vertical): (r.lead_count, r.outbound_transfers, r.outbound_paid_calls, r.outbound_calls_over_threshold)
             for r in outbound_on_leads(facts(spark, rows), dedupe).collect()}
    assert found == {k: (len(v), moved[k], paid[k], over[k]) for k, v in sessions.items()}
    dim = dimension(spark, ("zz", 1, "d", "c", "Full O&O", "Health", "s", "m", "k", DAY))
    report = {(r.sub_id, r.vertical): r.leads_transferred for r in performance_report(facts(spark, rows), dim, dedupe_sessions=dedupe).collect()}
    assert all(report[k] == moved[k] for k in sessions)


def test_direct_metrics_and_best_placement(spark):
    rows = [
        fact(kind="Call", transfers=1, paid=1, duration=1200.0, placement="low", channel="x", revenue=5.0),
        fact(kind="Call", transfers=1, paid=0, duration=1199.0, placement="high", channel="y", revenue=9.0),
        fact(kind="Lead", session=1, placement="high", channel="x", revenue=9.0),
        fact(kind="Click", clicks=3, revenue=2.0), fact(kind="Click", clicks=None, revenue=None), fact(kind="Redirect", revenue=1.0),
        fact("n", kind="Lead", placement="only", channel=None, revenue=None),
        fact("n", kind="Lead", placement=None, channel=None, revenue=None),
        fact("w", kind="Lead", placement="seen", channel="z", revenue=1.0), fact("w", kind="Lead", placement=None, channel="z", revenue=2.0),
    ]
    found = {r.sub_id: r for r in direct_metrics(facts(spark, rows)).collect()}
    a = found["a"]
    assert (a.top_placement, a.top_channel) == ("high", "y")
    assert (a.direct_calls, a.direct_paid_calls, a.direct_calls_over_threshold, a.total_leads, a.total_clicks, a.redirect_volume) == (2, 1, 1, 1, 3, 1)
    assert (a.call_revenue, a.lead_revenue, a.click_revenue, a.redirect_revenue, a.total_revenue) == (14, 9, 2, 1, 26)
    assert found["n"].total_revenue == 0 and found["n"].top_placement == "only"
    assert found["w"].top_placement is None  # the row with most revenue wins, even without a placement


def test_report_defaults_window_and_names(spark):
    rows = [fact("a", kind="Lead"), fact("b", "Pet"), fact("", "Health"), fact(None, "Health"), fact("UnKnown", "Health"),
            fact("c", day=dt.date(2023, 12, 31)), fact("d", kind="Call", transfers=1, day=dt.date(2024, 1, 31))]
    dim = dimension(spark, ("a", 2, "old", "c", "Full O&O", "Life", "s", "m", "k", dt.date(2024, 1, 1)),
                    ("a", 1, "new", "c", "Full O&O", "Auto", "s", "m", "k", dt.date(2024, 1, 2)))
    report = {r.sub_id: r for r in performance_report(facts(spark, rows), dim, dt.date(2024, 1, 1), dt.date(2024, 1, 31)).collect()}
    assert set(report) == {"a", "d"}
    assert (report["a"].vertical, report["a"].internal_channel, report["a"].description) == ("Auto", "Premium", "new")
    assert (report["d"].traffic_type, report["d"].internal_channel, report["d"].vertical) == ("Unknown", "", "Health")
    # No lead with a session: the transfer rate is unknown, not zero.
    assert report["a"].lead_transfer_rate is None and report["a"].leads_transferred == 0 and report["a"].qr_rate is None
    assert latest_snapshot(dim).count() == 1


def test_order_and_dates(spark, tables):
    assert last_n_days(31, dt.date(2024, 3, 1)) == (dt.date(2024, 1, 30), dt.date(2024, 2, 29))
    rows = [fact("a", revenue=1.0), fact("b", revenue=3.0), fact("c", revenue=2.0)]
    dim = dimension(spark, ("a", 1, "d", "c", "Full O&O", "Health", "s", "m", "k", DAY))
    assert [r.sub_id for r in sorted_report(performance_report(facts(spark, rows), dim)).collect()] == ["b", "c", "a"]
    assert in_window(facts(spark, rows), DAY, DAY).count() == 3


def test_usual_window_is_31_days(spark):
    today = dt.date.today()
    rows = [fact(f"d{n}", kind="Lead", revenue=1.0, day=today - dt.timedelta(days=n)) for n in (0, 1, 2, 30, 31, 32, 400)]
    dim = dimension(spark, ("a", 1, "d", "c", "Full O&O", "Health", "s", "m", "k", DAY))
    found = lambda **window: {r.sub_id for r in classify_facts(facts(spark, rows), dim, **window).collect()}
    # Yesterday and the 30 days before it; today's facts are not complete.
    assert found() == {"d1", "d2", "d30", "d31"}
    assert found(all_dates=True) == {r[0] for r in rows}
    assert found(start=today - dt.timedelta(days=32)) == {"d0", "d1", "d2", "d30", "d31", "d32"}
