"""Sets of selected sources and their comparison with the rest of the view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import one_of
from ..schema import COHORT, ORD
from .views import CATEGORY_ACTIONS

COMPARED = {"lead_volume": "lead_volume", "call_volume": "total_calls", "click_volume": "click_volume",
            "redirect_volume": "redirect_volume", "revenue": "total_revenue"}


def no_selection(view: DataFrame) -> DataFrame:
    return view.select("sub_id").limit(0)


def select_category(selection: DataFrame, view: DataFrame, category: str) -> DataFrame:
    """Add every visible source of a category. Here 'review' means reviews only."""
    actions = ("review",) if category == "review" else CATEGORY_ACTIONS.get(category, (category,))
    return selection.union(view.where(one_of(F.col("action"), actions)).select("sub_id")).distinct()


def select_visible(selection: DataFrame, view: DataFrame) -> DataFrame:
    return selection.union(view.select("sub_id")).distinct()


def toggle(selection: DataFrame, toggled: DataFrame) -> DataFrame:
    """Ids that are in exactly one of both sets (each given id toggled once)."""
    both = selection.select("sub_id", F.lit(1).alias("n")).unionByName(toggled.select("sub_id").distinct().withColumn("n", F.lit(1)))
    return both.groupBy("sub_id").agg(F.sum("n").alias("n")).where("n = 1").select("sub_id")


def selected_rows(view: DataFrame, selection: DataFrame) -> DataFrame:
    return view.join(selection.select("sub_id").distinct(), "sub_id", "left_semi")


def _first_rows(view: DataFrame, selection: DataFrame, direction: str | None) -> DataFrame:
    """One row per sub_id, the first in view order (see ``views.view_order``), with a selected flag.

    min_by combines on the map side, so a sub_id with very many rows is no hot task, and the
    result is already partitioned for the join with the selection.
    """
    row = F.struct(*COHORT, *[F.coalesce(F.col(c), F.lit(0.0)).alias(name) for name, c in COMPARED.items()])
    revenue = F.coalesce("total_revenue", F.lit(0.0))
    by = {"desc": [(-revenue).alias("r")], "asc": [revenue.alias("r")], None: []}[direction]
    place = F.struct(*by, F.col(ORD).alias("o"))
    first = view.groupBy("sub_id").agg(F.min_by(row, place).alias("row")).select("sub_id", "row.*")
    marked = selection.select("sub_id").distinct().withColumn("selected", F.lit(True))
    return first.join(marked, "sub_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def _sums(chosen: Column) -> list[Column]:
    sums = [F.count_if(chosen).alias("selected_count"), F.count("*").alias("total_count")]
    for name in COMPARED:
        sums.append(F.sum(F.when(chosen, F.col(name)).otherwise(F.lit(0.0))).alias(f"selected_{name}"))
        sums.append(F.sum(name).alias(f"total_{name}"))
    return sums


def _with_percentages(compared: DataFrame) -> DataFrame:
    def percent(name: str) -> Column:
        whole = F.col(f"total_{name}")
        return F.when(whole > 0, F.col(f"selected_{name}") / whole * 100).otherwise(F.lit(0.0))

    return compared.withColumns({f"{name}_pct": percent(name) for name in COMPARED})


def compare_groups(view: DataFrame, selection: DataFrame, direction: str | None = "desc") -> DataFrame:
    """Selected against all, per (vertical, traffic type) that holds a selected source."""
    groups = _first_rows(view, selection, direction).groupBy(*COHORT).agg(*_sums(F.col("selected")))
    return _with_percentages(groups.where("selected_count > 0"))


def compare_total(view: DataFrame, selection: DataFrame, direction: str | None = "desc") -> DataFrame:
    """Selected against all, over the verticals that hold a selected source; no row without any."""
    verticals = _first_rows(view, selection, direction).groupBy("vertical").agg(*_sums(F.col("selected"))).where("selected_count > 0")
    columns = [c for c in verticals.columns if c != "vertical"]
    total = verticals.agg(*[F.sum(c).alias(c) for c in columns],
                          F.sort_array(F.collect_list("vertical")).alias("verticals"))
    return _with_percentages(total.where("selected_count > 0"))
