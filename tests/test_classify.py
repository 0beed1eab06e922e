from __future__ import annotations

import pytest

from helpers import source, sources
from sourcegauge.operators.classify import action_stats, classify
from sourcegauge.sources.thresholds import threshold_table, with_overrides

# sub_id, vertical, traffic, channel, calls over / calls, transferred / leads, revenue, action, recommended
GOLDEN = [
    ("SUB001", "Medicare", "Full O&O", "Premium", 1125, 1500, 640, 800, 93600, "keep_premium", "Premium"),
    ("SUB002", "Health", "Partial O&O", "Standard", 712, 950, 420, 600, 47600, "upgrade_to_premium", "Premium"),
    ("SUB003", "Auto", "Non O&O", None, 1650, 2200, 715, 1100, 104200, "no_premium_available", "Standard"),
    ("SUB004", "Home", "Full O&O", "Premium", 640, 800, 340, 400, 36450, "keep_premium", "Premium"),
    ("SUB005", "Life", "Partial O&O", "Standard", 825, 1100, 385, 550, 55050, "upgrade_to_premium", "Premium"),
    ("SUB006", "Medicare", "Full O&O", "Premium", 2400, 3000, 1200, 1500, 152250, "keep_premium", "Premium"),
    ("SUB007", "Health", "Non O&O", None, 315, 450, 150, 250, 21125, "no_premium_available", "Standard"),
    ("SUB008", "Auto", "Partial O&O", "Standard", 1260, 1800, 630, 900, 85400, "no_premium_available", "Standard"),
    ("SUB009", "Home", "Full O&O", "Premium", 520, 650, 276, 325, 30530, "keep_premium", "Premium"),
    ("SUB010", "Life", "Partial O&O", "Standard", 910, 1300, 455, 650, 62150, "upgrade_to_premium", "Premium"),
]


def golden_sources(spark):
    return sources(spark, [
        source(i, s, v, t, ch, calls_over_threshold=over, total_calls=calls, leads_transferred=moved, lead_volume=leads, total_revenue=rev)
        for i, (s, v, t, ch, over, calls, moved, leads, rev, _, _) in enumerate(GOLDEN)])


def test_golden_actions(spark):
    rows = {r.sub_id: r for r in classify(golden_sources(spark)).collect()}
    for s, v, t, ch, *_, action, recommended in GOLDEN:
        assert (rows[s].action, rows[s].recommended_classification) == (action, recommended), s
        assert rows[s].is_unmapped == (ch is None)
    assert rows["SUB001"].classification_reason == "All metrics in Premium range. Call: 75.00% (Premium), Lead: 80.00% (Premium)"


def test_golden_stats(spark):
    stats = action_stats(classify(golden_sources(spark))).first().asDict()
    assert stats == {"total_records": 10, "promote": 3, "correct": 7, "demote": 0, "below": 0, "review": 0, "pause": 0, "insufficient_volume": 0}


BOUNDARY = [
    # case, channel, calls over, transferred, action, further values
    ("both premium at the edge", "Premium", 140, 90, "keep_premium", {}),
    ("one just below premium", "Premium", 139, 90, "keep_premium_watch", {}),
    ("both standard", "Premium", 139, 89, "demote_to_standard", {}),
    ("one pause at the edge", "Premium", 60, 90, "demote_with_warning", {}),
    ("gap counts as standard", "Premium", 65, 90, "keep_premium_watch", {}),
    ("standard, both premium", "Standard", 140, 90, "upgrade_to_premium", {}),
    ("standard, one premium", "Standard", 140, 89, "keep_standard_close", {}),
    ("standard, both standard", "Standard", 70, 50, "keep_standard", {}),
    ("standard, one pause", "Standard", 60, 50, "warning_14_day", {}),
    ("empty, both pause", "", 60, 40, "pause_immediate", {}),
    ("too little", "Standard", 10, 10, "insufficient_volume", {"total_calls": 49, "lead_volume": 99}),
    ("nothing", "Standard", 0, 0, "insufficient_volume", {"total_calls": 0, "lead_volume": 0}),
    ("only leads count", "Standard", 40, 40, "pause_immediate", {"total_calls": 49}),
    ("no premium tier", "Premium", 500, 500, "no_premium_available", {"traffic_type": "Non O&O"}),
    ("no premium tier, one pause", "Premium", 10, 500, "warning_14_day", {"traffic_type": "Non O&O"}),
    ("no premium tier, all pause", "Premium", 10, 1, "pause_immediate", {"traffic_type": "Non O&O"}),
    ("unknown vertical", "Premium", 1, 1, "no_premium_available", {"vertical": "Pet"}),
    ("spelled channel", " PREMIUM ", 140, 90, "keep_premium", {}),
    ("null as text", "null", 140, 90, "upgrade_to_premium", {}),
    ("blank channel", "  ", 140, 90, "upgrade_to_premium", {}),
]


@pytest.fixture(scope="module")
def boundary(spark):
    rows = []
    for i, (case, channel, over, moved, _, more) in enumerate(BOUNDARY):
        values = {"total_calls": 1000, "lead_volume": 1000, "calls_over_threshold": over, "leads_transferred": moved, **more}
        rows.append(source(i, case, internal_channel=channel, **values))
    return {r.sub_id: r for r in classify(sources(spark, rows)).collect()}


@pytest.mark.parametrize("case,action", [(b[0], b[4]) for b in BOUNDARY])
def test_boundary_action(boundary, case, action):
    assert boundary[case].action == action


def test_boundary_details(boundary):
    assert boundary["too little"].classification_reason == "Insufficient volume: Call: 49/50, Lead: 99/100"
    assert boundary["nothing"].insufficient_volume_reason == "Insufficient volume: No data"
    assert boundary["nothing"].call_cls is None and boundary["nothing"].call_quality_rate is None
    assert boundary["empty, both pause"].is_unmapped and boundary["null as text"].is_unmapped
    assert not boundary["blank channel"].is_unmapped
    assert boundary["empty, both pause"].pause_reason == boundary["empty, both pause"].classification_reason
    assert boundary["only leads count"].classification_reason == (
        "Both metrics in Pause range - pausing immediately. Lead: 4.00% (Pause)")
    assert boundary["unknown vertical"].call_cls.tier == "Unknown"
    assert boundary["no premium tier"].premium_min is None and boundary["both standard"].premium_min == 0.14
    assert boundary["one pause at the edge"].has_warning and boundary["one pause at the edge"].recommended_classification == "Standard"
    assert boundary["too little"].recommended_classification == "Standard"


def test_overrides(spark):
    edits = spark.createDataFrame([
        ("Health", "Full O&O", "call", "premium_min", "20%", 1),
        ("Health", "Full O&O", "call", "premium_min", "30 %", 2),
        ("Health", "Full O&O", "call", "premium_min", "none", 3),
        ("Nowhere", "Full O&O", "call", "premium_min", "1%", 4),
    ], "vertical STRING, traffic_type STRING, metric STRING, field STRING, raw STRING, edit_no INT")
    merged = with_overrides(threshold_table(spark), edits)
    assert merged.count() == 15
    row = merged.where("vertical = 'Health' AND traffic_type = 'Full O&O'").first()
    assert (row.call_premium_min, row.call_standard_min, row.lead_premium_min, row.call_seconds) == (0.30, 0.07, 0.09, 1200)
