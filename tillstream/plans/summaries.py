"""One headline sentence per warehouse query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions.columns import money_sum, pounds
from tillstream.operators.star import Star
from tillstream.plans import revenue

# The question each query answers, by its intent name.
INTENTS = [
    "revenue_trend", "top_products", "geo_revenue", "daily_series", "reorder_signals",
    "rfm_summary", "cohort_retention",
]
NO_DATA = "No data available."


def intent_result(star: Star, intent: str) -> DataFrame:
    return {
        "revenue_trend": revenue.monthly_revenue_trend,
        "top_products": revenue.top_products,
        "geo_revenue": revenue.geo_revenue,
        "daily_series": revenue.daily_sales_series,
        "reorder_signals": lambda s: revenue.reorder_signals(s, rows=None),  # the headline counts all
        "rfm_summary": revenue.customer_rfm_summary,
        "cohort_retention": revenue.cohort_retention,
    }[intent](star)


def _rows_text() -> Column:
    return F.concat(F.count("*").cast("string"), F.lit(" rows retrieved."))


def _headline(intent: str) -> Column:
    """Aggregate over the rows of the intent's result; the sentence formats are fixed values."""
    if intent == "revenue_trend":
        return F.concat(
            F.lit("Total revenue across "), F.count("*").cast("string"), F.lit(" months: "),
            pounds(money_sum(F.col("revenue"))),
        )
    if intent == "top_products":
        first = F.min_by(
            F.struct("description", "total_revenue"), F.struct("revenue_rank", "stock_code")
        )
        return F.concat(
            F.lit("Top product: '"), first["description"], F.lit("' with "),
            pounds(first["total_revenue"]),
        )
    if intent == "geo_revenue":
        first = F.min_by(
            F.struct("country", "total_revenue"), F.struct(-F.col("total_revenue"), "country")
        )
        return F.concat(
            F.lit("Top country: "), first["country"], F.lit(" with "), pounds(first["total_revenue"])
        )
    if intent == "reorder_signals":
        return F.concat(F.count("*").cast("string"), F.lit(" products flagged for reorder"))
    if intent == "rfm_summary":
        high = F.max(F.when(F.col("customer_segment") == "HIGH", F.col("num_customers")))
        return F.coalesce(
            F.concat(F.lit("HIGH-value customers: "), high.cast("string")), _rows_text()
        )
    return _rows_text()


def query_summary(result: DataFrame, intent: str) -> DataFrame:
    """(intent, row_count, summary) of one query result."""
    return result.agg(
        F.lit(intent).alias("intent"),
        F.count("*").alias("row_count"),
        F.when(F.count("*") == 0, NO_DATA).otherwise(_headline(intent)).alias("summary"),
    )


def query_summaries(star: Star) -> DataFrame:
    parts = [query_summary(intent_result(star, intent), intent) for intent in INTENTS]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
