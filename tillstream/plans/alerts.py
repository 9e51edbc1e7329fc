"""Alert and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstream.functions.columns import one_decimal, pounds

# Alert limits; the message formats below are fixed as well.
HIGH_URGENCY_BELOW = -40.0
ANOMALY_ABOVE = 50.0
CONTEXT_ROWS = 10
JSON_ROWS = 5


def reorder_alerts(signals: DataFrame) -> DataFrame:
    """One alert per reorder signal."""
    change = F.coalesce("unit_change_pct", F.lit(0.0))
    return signals.select(
        F.lit("REORDER_REQUIRED").alias("type"),
        F.coalesce("description", F.lit("Unknown")).alias("product"),
        "stock_code",
        change.alias("change_pct"),
        F.when(change < HIGH_URGENCY_BELOW, "HIGH").otherwise("MEDIUM").alias("urgency"),
        F.concat(
            F.lit("⚠️  REORDER ALERT: '"), F.coalesce("description", F.lit("")),
            F.lit("' sales dropped "), one_decimal(F.abs(change)),
            F.lit("% vs prior period. Immediate restocking recommended."),
        ).alias("message"),
    )


def reorder_alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("alert_count"),
        F.count_if(F.col("urgency") == "HIGH").alias("high_urgency"),
    )


def anomaly_alerts(trend: DataFrame) -> DataFrame:
    """Months whose revenue moved by more than 50 %."""
    pct = F.col("mom_growth_pct")
    period = F.concat_ws(" ", "month_name", F.col("year").cast("string"))
    rise = pct > 0
    return trend.where(F.abs(pct) > ANOMALY_ABOVE).select(
        period.alias("period"),
        pct.alias("growth_pct"),
        "revenue",
        F.when(rise, "SPIKE").otherwise("DROP").alias("alert_type"),
        F.concat(
            F.when(rise, "📈 SPIKE").otherwise("📉 DROP"), F.lit(": "), period,
            F.lit(" showed "), one_decimal(F.abs(pct)), F.lit("% "),
            F.when(rise, "growth").otherwise("decline"), F.lit(" ("),
            pounds(F.col("revenue")), F.lit(")"),
        ).alias("message"),
    )


def forecast_report(forecast: DataFrame) -> DataFrame:
    """One row per series: the horizon as arrays in date order, the projected total, and its bounds where
    the forecasts carry them."""
    bounds = [name for name in ("total_lower", "total_upper") if name in forecast.columns]
    days = F.array_sort(
        F.collect_list(F.struct("ds", "forecast", "lower_ci", "upper_ci"))
    )
    return (
        forecast.groupBy("series")
        .agg(
            days.alias("days"), F.round(F.sum("forecast"), 2).alias("total_projected"),
            *[F.max(name).alias(name) for name in bounds],
        )
        .select(
            "series",
            F.lit("demand_forecast").alias("type"),
            F.concat(F.size("days").cast("string"), F.lit(" days")).alias("horizon"),
            F.transform("days", lambda d: d["ds"].cast("string")).alias("dates"),
            F.col("days.forecast").alias("forecast"),
            F.col("days.lower_ci").alias("lower_ci"),
            F.col("days.upper_ci").alias("upper_ci"),
            "total_projected",
            *bounds,
        )
    )


def insight_records(result: DataFrame, intent: str, order: list) -> DataFrame:
    """The first ten rows of a result; the first five also as JSON context.

    Only a limited result enters the window.
    """
    place = F.row_number().over(Window.orderBy(*order))
    return (
        result.orderBy(*order)
        .limit(CONTEXT_ROWS)
        .withColumn("place", place)
        .select(
            F.lit(intent).alias("intent"),
            "place",
            *result.columns,
            F.when(F.col("place") <= JSON_ROWS, F.to_json(F.struct(*result.columns))).alias("context"),
        )
    )
