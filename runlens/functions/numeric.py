"""Number columns: ratios, unit changes, rounding, report formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_MS = 1e6


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double; x/0 is infinity and 0/0 is NaN, as in IEEE arithmetic."""
    top, bottom = top.cast("double"), bottom.cast("double")
    at_zero = (
        F.when(top.isNull(), F.lit(None).cast("double"))
        .when(top == 0, F.lit(float("nan")))
        .otherwise(F.signum(top) * F.lit(float("inf")))
    )
    return F.when(bottom == 0, at_zero).otherwise(F.try_divide(top, bottom))


def share(part: Column, base: Column) -> Column:
    """``part / base``, NULL for an empty base."""
    return F.try_divide(part.cast("double"), base.cast("double"))


def percent(part: Column, base: Column) -> Column:
    return share(part, base) * 100


def ms_to_ns(ms: Column) -> Column:
    return ms * F.lit(NS_PER_MS)


def ns_to_ms(ns: Column) -> Column:
    return ns / F.lit(NS_PER_MS)


def round_half_even(value: Column, to: str = "int") -> Column:
    """Whole number nearest to ``value``, halves to even."""
    return F.bround(value, 0).cast(to)


def number_text(value: Column, digits: int = 2, unit: str = "") -> Column:
    """Fixed-point text, ``N/A`` for NULL."""
    text = F.format_string(f"%.{digits}f", value.cast("double"))
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.concat(text, F.lit(unit)))


def percent_text(part: Column, base: Column, digits: int = 2) -> Column:
    return number_text(percent(part, base), digits, "%")
