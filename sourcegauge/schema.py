"""Column sets that operators agree on."""

from __future__ import annotations

# Texts of a source row; '' stands for missing, except for internal_channel (NULL).
SOURCE_TEXTS = (
    "channel", "placement", "description", "source_name", "media_type", "campaign_type",
)
# Measures of a source row (DOUBLE, 0 for missing) and the upload column each comes from.
MEASURES = {
    "total_calls": "total_calls",
    "paid_calls": "paid_calls",
    "calls_over_threshold": "calls_over_threshold",
    "call_revenue": "call_revenue",
    "lead_volume": "total_leads_dialed",
    "leads_transferred": "leads_transferred",
    "lead_revenue": "lead_revenue",
    "click_volume": "click_volume",
    "click_revenue": "click_revenue",
    "redirect_volume": "redirect_volume",
    "redirect_revenue": "redirect_revenue",
    "total_revenue": "total_revenue",
}
# Position of a row in its input. Any orderable type: several rules speak of the "first" row.
ORD = "ord"
SOURCE_ROW = (ORD, "sub_id", "vertical", "traffic_type", "internal_channel", *SOURCE_TEXTS, *MEASURES)
COHORT = ("vertical", "traffic_type")
