"""Cleaned sales as live events: the sequence numbers a feed carries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstream.operators.keys import dense_key, short_origin

_ORDER = [
    "InvoiceDate", "Invoice", "StockCode", "Quantity", "Price", "CustomerID", "Country",
    "Description", "source_file", "source_row",
]
_ORIGIN = ["source_file", "source_row"]


def enrich_events(sales: DataFrame, tasks: int | None = None) -> DataFrame:
    """One event per sale with its day number and its place in the day, both from 0.

    ``sales`` comes from ``read_lake(..., with_row_id=True)``. Sales are numbered once over all
    days; the place in the day is that number less the sales of earlier days. A day that holds
    much of the data is therefore sorted by many tasks. The day table has one row per calendar
    day, which bounds its window and its broadcast. With ``tasks`` the events come in order in so many
    partitions, which need not be dealt again to be stored.
    """
    rows = short_origin(sales.select(*_ORDER, "Revenue"))
    numbered = dense_key(rows, _ORDER, "_number", _ORIGIN, tasks).withColumn(
        "simulated_day", F.to_date("InvoiceDate")
    )
    in_order = Window.orderBy("simulated_day")
    days = (
        numbered.groupBy("simulated_day")
        .agg(F.count("*").alias("total_in_day"))
        .select(
            "simulated_day",
            "total_in_day",
            (F.row_number().over(in_order) - 1).alias("day_index"),
            F.coalesce(
                F.sum("total_in_day").over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_earlier"),
        )
    )
    place = F.col("_number") - 1 - F.col("_earlier")
    return numbered.join(F.broadcast(days), "simulated_day").select(
        F.col("Invoice").alias("invoice"),
        F.col("StockCode").alias("stock_code"),
        F.col("Description").alias("description"),
        F.col("Quantity").alias("quantity"),
        F.col("Price").alias("price"),
        F.col("Revenue").alias("revenue"),
        F.col("CustomerID").alias("customer_id"),
        F.col("Country").alias("country"),
        F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("invoice_date"),
        F.col("simulated_day").cast("string").alias("simulated_day"),
        "day_index",
        (place == 0).alias("is_day_start"),
        (place == F.col("total_in_day") - 1).alias("is_day_end"),
        place.alias("row_in_day"),
        "total_in_day",
    )
