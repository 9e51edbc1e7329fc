"""Column expressions shared by the plans. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price bands, segment limits and accuracy grades.
LOW_PRICE_BELOW = 2.0
MID_PRICE_BELOW = 10.0
HIGH_SCORE_FROM = 0.66
MID_SCORE_FROM = 0.33
GOOD_MAPE_BELOW = 20.0
FAIR_MAPE_BELOW = 40.0
GUEST = "GUEST"
MISSING_ID_TEXT = "nan"


def price_band(price: Column, low: float = LOW_PRICE_BELOW, mid: float = MID_PRICE_BELOW) -> Column:
    return F.when(price < low, "LOW").when(price < mid, "MID").otherwise("HIGH")


def rfm_segment(score: Column, high: float = HIGH_SCORE_FROM, mid: float = MID_SCORE_FROM) -> Column:
    return F.when(score >= high, "HIGH").when(score >= mid, "MID").otherwise("LOW")


def customer_or_guest(customer: Column) -> Column:
    """The customer id, or GUEST where it is null, blank or the text of a missing value."""
    text = F.trim(customer)
    return F.when(
        customer.isNull() | (text == "") | (F.lower(text) == MISSING_ID_TEXT), GUEST
    ).otherwise(customer)


def accuracy_grade(mape: Column, good: float = GOOD_MAPE_BELOW, fair: float = FAIR_MAPE_BELOW) -> Column:
    """GOOD, FAIR or POOR; null while no day has been scored."""
    return (
        F.when(mape.isNull(), None)
        .when(mape < good, "GOOD")
        .when(mape < fair, "FAIR")
        .otherwise("POOR")
    )


def cents(amount: Column) -> Column:
    return F.rint(amount * 100).cast("long")


def money_sum(amount: Column) -> Column:
    """Sum of a two-decimal amount, added up as whole cents.

    Integer addition gives the same total in whatever order tasks deliver their parts, also
    after a task was run again.
    """
    return F.sum(cents(amount)) / F.lit(100.0)


def date_key(day: Column) -> Column:
    """yyyymmdd as an integer."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def month_key(key: Column) -> Column:
    """yyyymm of a yyyymmdd key."""
    return F.floor(key / 100).cast("int")


def day_of_key(key: Column) -> Column:
    return F.to_date(key.cast("string"), "yyyyMMdd")


def growth_pct(now: Column, before: Column) -> Column:
    """Change in percent, two decimals; null without a previous value or when that is zero."""
    return F.round(F.lit(100.0) * (now - before) / F.nullif(before, F.lit(0)), 2)


def ape_pct(predicted: Column, actual: Column) -> Column:
    """Absolute percentage error; null unless there is a positive actual."""
    return F.when(actual > 0, F.abs(predicted - actual) / actual * 100)


def pounds(amount: Column) -> Column:
    """£1,234.50"""
    return F.concat(F.lit("£"), F.format_number(amount, 2))


def one_decimal(value: Column) -> Column:
    """12345.6, without group separators."""
    return F.regexp_replace(F.format_number(value, 1), ",", "")
