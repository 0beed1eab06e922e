from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcegauge.functions.lookup import pick
from sourcegauge.functions.numbers import fixed_text, grouped_text, parse_number, plain_text, round_half_up, threshold_text


def values(spark, function, items, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_numeric_prefix(spark):
    cells = ["1,500", "12abc", " -12.5x", "$5", "", "1e3", None, ".5", "5.", "+7", "1e", "-", "abc", "-0", "\t3"]
    expected = [1, 12, -12.5, 0, 0, 1000, 0, 0.5, 5, 7, 1, 0, 0, 0, 3]
    assert values(spark, parse_number, cells, "string") == expected


def test_round_half_up(spark):
    assert values(spark, round_half_up, [2.5, -2.5, -2.6, 0.49, 0.5]) == [3, -2, -3, 0, 1]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_fixed_text_rounds_the_exact_value(spark, digits):
    numbers = [0.125, 0.375, 1.005, 0.5, 1.5, 2.5, 0.25, 0.75, 12.345, 33.333333, 1234567.891, -0.125, 0.03125, 1.45, 8.345, 0.0]
    step = Decimal(1).scaleb(-digits)
    expected = [f"{Decimal(x).quantize(step, ROUND_HALF_UP):f}" for x in numbers]
    assert values(spark, lambda c: fixed_text(c, digits), numbers) == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=20, max_size=60))
def test_fixed_text_property(spark, numbers):
    expected = [f"{Decimal(x).quantize(Decimal('0.01'), ROUND_HALF_UP):f}" for x in numbers]
    assert values(spark, lambda c: fixed_text(c, 2), numbers) == expected


def test_other_texts(spark):
    assert values(spark, grouped_text, [1234.5, 1000000.0, 0.0, 12.3456, 999.9996]) == ["1,234.5", "1,000,000", "0", "12.346", "1,000"]
    assert values(spark, plain_text, [30.0, 30.5, 0.0]) == ["30", "30.5", "0"]
    assert values(spark, threshold_text, [0.007, 0.0075, 0.06, 0.0625, 0.25, 0.0, None, 0.015]) == [
        "0.70%", "0.75%", "6.0%", "6.25%", "25.0%", "0.0%", "—", "1.5%"]


def test_pick(spark):
    table = {"a": "it's", "b": "${x} \\ y"}
    assert values(spark, lambda c: pick(c, table, "none"), ["a", "z", None], "string") == ["it's", "none", "none"]
    assert values(spark, lambda c: pick(c, {"a": 1.5, "b": 2}), ["a", "b", "c"], "string") == [1.5, 2.0, None]
