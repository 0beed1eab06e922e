"""Business constants of the domain.

Everything in this module is a fixed value: results depend on these numbers and texts
being exactly as they are.
"""

from __future__ import annotations

VERTICALS = ("Medicare", "Health", "Life", "Auto", "Home")
TRAFFIC_TYPES = ("Full O&O", "Partial O&O", "Non O&O")
INTERNAL_CHANNELS = ("Premium", "Standard")

# Seconds a call must last to count as a quality call.
CALL_SECONDS = {"Medicare": 2700, "Health": 1200, "Life": 2100, "Auto": 1200, "Home": 1200}

# Least volume for a metric to take part in a decision.
MIN_CALLS = 50
MIN_LEADS = 100

# vertical, traffic type, call (premium, standard, pause, target), lead (same four).
# None: no Premium tier for that pair.
THRESHOLDS = (
    ("Medicare", "Full O&O", (0.09, 0.06, 0.05, 0.10), (0.015, 0.008, 0.007, 0.02)),
    ("Medicare", "Partial O&O", (None, 0.07, 0.06, 0.08), (None, 0.008, 0.007, 0.01)),
    ("Medicare", "Non O&O", (None, 0.04, 0.03, 0.07), (None, 0.005, 0.004, 0.01)),
    ("Health", "Full O&O", (0.14, 0.07, 0.06, 0.15), (0.09, 0.05, 0.04, 0.09)),
    ("Health", "Partial O&O", (0.12, 0.05, 0.04, 0.14), (0.07, 0.03, 0.02, 0.07)),
    ("Health", "Non O&O", (None, 0.04, 0.03, 0.06), (None, 0.02, 0.01, 0.03)),
    ("Life", "Full O&O", (0.10, 0.06, 0.05, 0.12), (0.015, 0.0075, 0.007, 0.02)),
    ("Life", "Partial O&O", (0.09, 0.05, 0.04, 0.10), (0.015, 0.0075, 0.007, 0.02)),
    ("Life", "Non O&O", (None, 0.05, 0.03, 0.08), (None, 0.005, 0.004, 0.01)),
    ("Auto", "Full O&O", (0.25, 0.20, 0.19, 0.26), (0.025, 0.015, 0.014, 0.03)),
    ("Auto", "Partial O&O", (None, 0.15, 0.14, 0.16), (None, 0.01, 0.009, 0.02)),
    ("Auto", "Non O&O", (None, 0.10, 0.09, 0.11), (None, 0.008, 0.007, 0.01)),
    ("Home", "Full O&O", (0.25, 0.20, 0.19, 0.26), (0.025, 0.015, 0.014, 0.03)),
    ("Home", "Partial O&O", (None, 0.10, 0.09, 0.11), (None, 0.01, 0.009, 0.01)),
    ("Home", "Non O&O", (None, 0.10, 0.09, 0.10), (None, 0.008, 0.007, 0.01)),
)

# Groups of action codes. The short codes are those of older exports.
PROMOTE = ("upgrade_to_premium", "promote")
PAUSE = ("pause_immediate", "pause")
WARN = ("warning_14_day", "below")
DEMOTE = ("demote_to_standard", "demote_with_warning", "demote")

ACTION_LABELS = {
    "keep_premium": "✓ Premium",
    "keep_premium_watch": "⚠️ Premium (Watch)",
    "demote_to_standard": "↓ Demote to Standard",
    "demote_with_warning": "↓ Demote + 14d Warning",
    "upgrade_to_premium": "↑ Upgrade to Premium",
    "keep_standard_close": "Standard (Almost Premium)",
    "keep_standard": "✓ Standard",
    "warning_14_day": "⚠️ 14-Day Warning",
    "pause_immediate": "🛑 PAUSE TODAY",
    "insufficient_volume": "📊 Low Volume",
    "no_premium_available": "✓ Standard (Max)",
    "review": "🔍 Review",
}

# Counter that an action adds to.
STAT_CATEGORIES = {
    "upgrade_to_premium": "promote",
    "demote_to_standard": "demote",
    "demote_with_warning": "demote",
    "warning_14_day": "below",
    "pause_immediate": "pause",
    "keep_premium": "correct",
    "keep_premium_watch": "correct",
    "keep_standard": "correct",
    "keep_standard_close": "correct",
    "no_premium_available": "correct",
    "insufficient_volume": "insufficient_volume",
}
STAT_NAMES = ("promote", "demote", "below", "correct", "review", "pause", "insufficient_volume")

# Accepted headers per canonical upload column (lower case, blanks as underscores).
HEADER_ALIASES = {
    "subid": ("subid", "sub_id"),
    "internal_channel": ("internal_channel", "internalchannel"),
    "traffic_type": ("traffic_type", "traffictype"),
    "vertical": ("vertical", "vertical_name"),
    "current_classification": ("current_classification", "classification"),
    "is_unmapped": ("is_unmapped", "isunmapped", "unmapped"),
    "channel": ("channel",),
    "placement": ("placement",),
    "description": ("description",),
    "source_name": ("source_name", "sourcename", "ad_source"),
    "media_type": ("media_type", "mediatype", "media_type_name"),
    "campaign_type": ("campaign_type", "campaigntype"),
    "total_calls": ("total_calls", "call_volume"),
    "paid_calls": ("paid_calls", "paidcalls"),
    "calls_over_threshold": ("calls_over_threshold",),
    "call_quality_rate": ("call_quality_rate",),
    "call_revenue": ("call_revenue", "callrevenue"),
    "total_leads_dialed": ("total_leads_dialed", "leads_dialed", "lead_volume"),
    "leads_transferred": ("leads_transferred", "transfers"),
    "lead_transfer_rate": ("lead_transfer_rate", "ob_transfer_rate", "transfer_rate"),
    "lead_revenue": ("lead_revenue", "leadrevenue"),
    "click_volume": ("click_volume", "clicks", "total_clicks"),
    "click_revenue": ("click_revenue", "clickrevenue"),
    "redirect_volume": ("redirect_volume", "redirects", "total_redirects"),
    "redirect_revenue": ("redirect_revenue", "redirectrevenue"),
    "total_revenue": ("total_revenue", "revenue"),
}
REQUIRED_COLUMNS = ("subid", "traffic_type", "vertical")
