"""Cleaning of raw sales rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: invoices that start with this letter are cancellations.
CANCELLED = "C"


def is_cancelled() -> Column:
    """True for a cancellation; a missing invoice number is not one."""
    return F.coalesce(F.col("Invoice").startswith(CANCELLED), F.lit(False))


def is_complete() -> Column:
    return F.col("Description").isNotNull() & F.col("InvoiceDate").isNotNull()


def is_positive() -> Column:
    return F.coalesce((F.col("Quantity") > 0) & (F.col("Price") > 0), F.lit(False))


def with_customer_id(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("Customer ID", "CustomerID")


def keep_sales(raw: DataFrame) -> DataFrame:
    """Rows that count as sales. Guests stay."""
    return with_customer_id(raw).where(~is_cancelled() & is_complete() & is_positive())


def with_revenue(sales: DataFrame) -> DataFrame:
    return sales.withColumns(
        {
            "Revenue": F.round(F.col("Quantity") * F.col("Price"), 2),
            "Year": F.year("InvoiceDate"),
            "Month": F.month("InvoiceDate"),
        }
    )


def clean_sales(raw: DataFrame) -> DataFrame:
    return with_revenue(keep_sales(raw))


def cleaning_report(raw: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One row: raw, kept and dropped counts; a dropped row counts under the first rule it broke.

    With the ``rejected`` lines of the same files, ``skipped_lines`` counts those that are no raw rows,
    and ``lines`` all lines of the files.
    """
    live = ~is_cancelled()
    report = raw.agg(
        F.count("*").alias("raw_rows"),
        F.count_if(live & is_complete() & is_positive()).alias("kept_rows"),
        F.count_if(~live).alias("cancelled_rows"),
        F.count_if(live & ~is_complete()).alias("incomplete_rows"),
        F.count_if(live & is_complete() & ~is_positive()).alias("non_positive_rows"),
    )
    if rejected is None:
        return report
    skipped = rejected.agg(F.count_if(~F.col("kept")).alias("skipped_lines"))
    return report.join(F.broadcast(skipped)).withColumn("lines", F.col("raw_rows") + F.col("skipped_lines"))  # one row each
