"""Number parsing, rounding and number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the numeric prefix that a cell may start with.
NUMBER_PREFIX = r"^[\s\x{00A0}\x{FEFF}]*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def parse_number(cell: Column) -> Column:
    """Numeric prefix of a text cell; 0 when there is none ('12abc' -> 12, '$5' -> 0)."""
    prefix = F.regexp_extract(cell, NUMBER_PREFIX, 1)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0)) + F.lit(0.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity (as BIGINT)."""
    return F.floor(x + F.lit(0.5))


def _away_from_ties(x: Column, digits: int) -> Column:
    # A double lies exactly between two texts only if x * 2^(digits+1) is an odd integer.
    # format_number rounds such halves to even; half a unit less than a digit lifts them.
    halves = F.abs(x * F.lit(float(2 ** (digits + 1))))
    return F.when(halves % 2 == 1, x + F.signum(x) * F.lit(0.05 * 10.0 ** -digits)).otherwise(x)


def fixed_text(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, halves away from zero, no grouping."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", _away_from_ties(x, digits), F.lit(pattern))


def grouped_text(x: Column) -> Column:
    """Text with thousands separators and up to three decimals ('1,234.5')."""
    return F.call_function("format_number", _away_from_ties(x, 3), F.lit("#,##0.###"))


def percent_text(rate: Column, digits: int) -> Column:
    return F.concat(fixed_text(rate * 100, digits), F.lit("%"))


def plain_text(x: Column) -> Column:
    """Shortest text of a double; whole numbers without decimals."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def threshold_text(rate: Column) -> Column:
    """Percentage of a threshold, keeping the decimals that matter below 10 %."""
    pct = rate * 100
    two = fixed_text(pct, 2)
    return (
        F.when(rate.isNull(), F.lit("—"))
        .when((F.abs(pct) < 1) & (pct != 0), F.concat(two, F.lit("%")))
        .when((F.abs(pct) < 10) & ~two.endswith("0"), F.concat(two, F.lit("%")))
        .otherwise(F.concat(fixed_text(pct, 1), F.lit("%")))
    )
