"""CSV export of a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_text, plain_text
from ..operators.views import view_order

# Name of the first column per dimension. "Media Type" is also a later column,
# and Spark writes no two columns of one name, hence the added word.
DIMENSION_LABELS = {
    "sub_id": "Sub ID",
    "source_name": "Advertising Source",
    "placement": "Placement",
    "media_type": "Media Type Group",
    "overall": "Overall",
}


def export_rows(view: DataFrame, dimension: str = "sub_id") -> DataFrame:
    """The 34 export columns as text."""

    def text(column: str) -> Column:
        return F.coalesce(column, F.lit(""))

    def yes_no(column: str) -> Column:
        return F.when(F.col(column), "Yes").otherwise("No")

    def count(column: str) -> Column:
        return plain_text(F.coalesce(column, F.lit(0.0)))

    def money(column: str) -> Column:
        return fixed_text(F.coalesce(column, F.lit(0.0)), 2)

    def rate(column: str) -> Column:
        return F.coalesce(fixed_text(F.col(column) * 100, 2), F.lit(""))

    def per_unit(column: str) -> Column:
        return F.coalesce(fixed_text(F.col(column), 4), F.lit(""))

    # The export's headers.
    columns = {
        "Vertical": text("vertical"),
        "Traffic Type": text("traffic_type"),
        "Internal Channel": text("internal_channel"),
        "Current Classification": text("current_classification"),
        "Is Unmapped": yes_no("is_unmapped"),
        "Recommended Classification": text("recommended_classification"),
        "Action": text("action_label"),
        "Is Paused": yes_no("is_paused"),
        "Pause Reason": text("pause_reason"),
        "Channel": text("channel"),
        "Description": text("description"),
        "Source": text("source_name"),
        "Media Type": text("media_type"),
        "Campaign Type": text("campaign_type"),
        "Call Volume": count("total_calls"),
        "Paid Calls": count("paid_calls"),
        "Calls Over Threshold": count("calls_over_threshold"),
        "Call Quality %": rate("call_quality_rate"),
        "Call Revenue": money("call_revenue"),
        "Lead Volume": count("lead_volume"),
        "Leads Transferred": count("leads_transferred"),
        "Lead Transfer Rate %": rate("lead_transfer_rate"),
        "Lead Revenue": money("lead_revenue"),
        "Click Volume": count("click_volume"),
        "Click Revenue": money("click_revenue"),
        "Redirect Volume": count("redirect_volume"),
        "Redirect Revenue": money("redirect_revenue"),
        "Total Revenue": money("total_revenue"),
        "RPLead": per_unit("rp_lead"),
        "RPQCall": per_unit("rp_qcall"),
        "RPClick": per_unit("rp_click"),
        "RPRedirect": per_unit("rp_redirect"),
        "Classification Reason": text("classification_reason"),
    }
    return view.select(text("sub_id").alias(DIMENSION_LABELS[dimension]), *[c.alias(name) for name, c in columns.items()])


def write_csv(view: DataFrame, path: str, dimension: str = "sub_id", direction: str | None = "desc") -> None:
    """Sorted export; quotes in cells are doubled."""
    rows = view.orderBy(*view_order(direction)).transform(export_rows, dimension)
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
