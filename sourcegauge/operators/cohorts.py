"""Statistics of each cohort (vertical, traffic type), one row per cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..schema import COHORT
from ..session import freeze
from .ordering import cumulate, middle

RATES = {"call": "call_quality_rate", "lead": "lead_transfer_rate", "revenue": "total_revenue"}


def premium(column: str = "current_classification") -> Column:
    return F.coalesce(F.col(column) == "Premium", F.lit(False))


def _value_counts(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values per group and metric with their counts (all, Premium, other)."""
    pairs = [F.struct(F.lit(name).alias("metric"), F.col(c).alias("value")) for name, c in RATES.items()]
    long = sources.select(*keys, premium().alias("is_premium"), F.inline(F.array(*pairs))).where("value IS NOT NULL")
    return long.groupBy(*keys, "metric", "value").agg(
        F.count("*").alias("n"),
        F.count_if("is_premium").alias("n_premium"),
        F.count_if(~F.col("is_premium")).alias("n_other"),
    )



def distribution(sources: DataFrame) -> DataFrame:
    """Per cohort: medians by tier and, per metric, the values where the percentile steps up.

    A percentile is round(100 * smaller / n), an integer from 0 to 100, so at most 101 values
    per cohort and metric say everything; sources look their percentile up in them.
    """
    keys = list(COHORT)
    ranked = cumulate(_value_counts(sources, keys), [*keys, "metric"], [F.col("value")], ["n", "n_premium", "n_other"])
    percentile = round_half_up(F.col("before_n") / F.col("whole_n") * 100)
    levels = ranked.groupBy(*keys, "metric", percentile.alias("percentile")).agg(
        F.min("value").alias("value"),
        # Each median position falls into exactly one level; keep its candidates.
        *[F.struct(
            _pick_place(w, F.floor((F.col(f"whole_{w}") - 1) / 2)).alias("low"),
            _pick_place(w, F.floor(F.col(f"whole_{w}") / 2)).alias("high"),
        ).alias(f"mid_{w}") for w in ("n_premium", "n_other")],
    )

    def steps(metric: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("metric") == metric, F.struct("value", "percentile"))))

    def median(w: str) -> Column:
        revenue = F.col("metric") == "revenue"
        return (F.max(F.when(revenue, F.col(f"mid_{w}.low"))) + F.max(F.when(revenue, F.col(f"mid_{w}.high")))) / 2

    return levels.groupBy(*keys).agg(
        *[steps(m).alias(f"steps_{m}") for m in RATES],
        median("n_premium").alias("median_premium"),
        median("n_other").alias("median_other"),
    )


def _pick_place(weight: str, place: Column) -> Column:
    inside = (F.col(f"before_{weight}") <= place) & (place < F.col(f"before_{weight}") + F.col(weight))
    return F.max(F.when(inside, F.col("value")))


def percentile_at(steps: Column, value: Column) -> Column:
    """Percentile of a value of the cohort, NULL for NULL."""
    reached = F.filter(steps, lambda step: step["value"] <= value)
    return F.try_element_at(reached, F.lit(-1))["percentile"]


def moments(sources: DataFrame) -> DataFrame:
    """Counts, sums, means and population deviations per cohort."""
    call, lead, revenue = (F.col(c) for c in RATES.values())
    return sources.groupBy(*COHORT).agg(
        F.count("*").alias("peers"),
        F.count(call).alias("call_peers"),
        F.count(lead).alias("lead_peers"),
        F.avg(call).alias("call_mean"),
        F.avg(lead).alias("lead_mean"),
        F.avg(revenue).alias("revenue_mean"),
        F.stddev_pop(call).alias("call_sd"),
        F.stddev_pop(lead).alias("lead_sd"),
        F.stddev_pop(revenue).alias("revenue_sd"),
        F.sum(revenue).alias("cohort_revenue"),
        F.count_if(premium()).alias("premium_peers"),
        F.count_if(~premium()).alias("other_peers"),
    )


def cohort_profile(sources: DataFrame) -> DataFrame:
    """All cohort statistics, frozen: the planner knows its size when it joins it back."""
    return freeze(moments(sources).join(distribution(sources), list(COHORT), "left"), "cohorts")


def portfolio_medians(sources: DataFrame) -> DataFrame:
    """One row: median revenue of Premium and of all other sources (NULL without sources)."""
    values = sources.groupBy(F.col("total_revenue").alias("value")).agg(
        F.count_if(premium()).alias("n_premium"), F.count_if(~premium()).alias("n_other")
    )
    ranked = cumulate(values, [], [F.col("value")], ["n_premium", "n_other"])
    return ranked.agg(*[
        middle(F.col("value"), F.col(f"before_{w}"), F.col(w), F.col(f"whole_{w}")).alias(f"median_{w[2:]}")
        for w in ("n_premium", "n_other")
    ])
