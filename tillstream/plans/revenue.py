"""Warehouse queries.

The fact is always reduced by its own keys before a dimension is joined, so the joins see one row
per group, and a window without partitions only ever sees rows that were aggregated to months,
segments or a top-n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstream.functions.columns import cents, day_of_key, growth_pct, money_sum, month_key
from tillstream.operators.star import Star

# Fixed values of the reorder rule and the report lengths.
REORDER_BELOW = 0.7
REORDER_ROWS = 50
TOP_PRODUCTS = 20
TOP_COUNTRIES = 15
TOP_ASKED = 10


def _revenue():
    return money_sum(F.col("revenue"))


def _months(star: Star) -> DataFrame:
    return star.dim_date.select(
        month_key(F.col("date_key")).alias("sale_month"), "year", "month", "month_name"
    ).distinct()


def monthly_revenue(star: Star) -> DataFrame:
    """Revenue and distinct invoices per month."""
    months = star.fact_sales.groupBy("sale_month").agg(
        _revenue().alias("revenue"), F.count_distinct("invoice").alias("orders")
    )
    return months.join(_months(star), "sale_month").select(
        "sale_month", "year", "month", "month_name", "revenue", "orders"
    )


def monthly_revenue_trend(star: Star) -> DataFrame:
    """Month over month: previous revenue and growth in percent."""
    by_month = Window.orderBy("year", "month")
    previous = F.lag("revenue").over(by_month)
    return (
        monthly_revenue(star)
        .drop("sale_month")
        .withColumn("prev_revenue", previous)
        .withColumn("mom_growth_pct", growth_pct(F.col("revenue"), F.col("prev_revenue")))
        .orderBy("year", "month")
    )


def top_products(star: Star, n: int = TOP_PRODUCTS) -> DataFrame:
    """The n products with the most revenue; ties at the end are broken by stock code.

    The rank over the n kept rows equals the rank over all products, because whatever ranks
    before a kept row is kept too.
    """
    top = (
        star.fact_sales.groupBy("product_key")
        .agg(
            F.sum("quantity").alias("total_units"),
            _revenue().alias("total_revenue"),
            F.count_distinct("invoice").alias("order_count"),
        )
        .orderBy(F.desc("total_revenue"), "product_key")
        .limit(n)
    )
    return (
        star.dim_product.join(F.broadcast(top), "product_key")
        .select(
            "stock_code",
            "description",
            "price_band",
            "total_units",
            "total_revenue",
            "order_count",
            F.rank().over(Window.orderBy(F.desc("total_revenue"))).alias("revenue_rank"),
        )
        .orderBy("revenue_rank", "stock_code")
    )


def customer_rfm_summary(star: Star) -> DataFrame:
    """Per segment: sales lines (``num_customers``, as the dashboards call it), customers,
    mean line revenue, revenue and its share."""
    buyers = star.fact_sales.groupBy("customer_key").agg(
        F.count("*").alias("lines"), F.sum(cents(F.col("revenue"))).alias("spent")
    )
    segments = (
        buyers.join(star.dim_customer.select("customer_key", "customer_segment"), "customer_key")
        .groupBy("customer_segment")
        .agg(
            F.sum("lines").alias("num_customers"),
            F.count("*").alias("distinct_customers"),
            F.sum("spent").alias("spent"),
        )
    )
    return segments.select(
        "customer_segment",
        "num_customers",
        "distinct_customers",
        F.round(F.col("spent") / 100.0 / F.col("num_customers"), 2).alias("avg_order_value"),
        (F.col("spent") / 100.0).alias("total_revenue"),
        F.round(100.0 * F.col("spent") / F.sum("spent").over(Window.partitionBy()), 2).alias(
            "revenue_share_pct"
        ),
    ).orderBy(F.desc("total_revenue"))


def segment_mix(star: Star) -> DataFrame:
    """Share of the sales lines per segment, in percent."""
    total = F.sum("num_customers").over(Window.partitionBy())
    return customer_rfm_summary(star).select(
        "customer_segment",
        "num_customers",
        total.alias("total"),
        F.round(100.0 * F.col("num_customers") / total, 2).alias("share_pct"),
    )


def geo_revenue(star: Star) -> DataFrame:
    """Revenue and distinct customers per country, ranked within the region."""
    countries = star.fact_sales.groupBy("geo_key").agg(
        _revenue().alias("total_revenue"),
        F.count_distinct("customer_key").alias("unique_customers"),
    )
    in_region = Window.partitionBy("region").orderBy(F.desc("total_revenue"))
    return (
        countries.join(star.dim_geography, "geo_key")
        .select(
            "region",
            "country",
            "total_revenue",
            "unique_customers",
            F.rank().over(in_region).alias("rank_in_region"),
        )
        .orderBy(F.desc("total_revenue"), "country")
    )


def daily_sales_series(star: Star, stock_code: str | None = None) -> DataFrame:
    """Revenue, units and orders per day with sales, of all products or one.

    ``orders`` adds up the distinct invoices of each product, so an invoice with three products
    counts three. The weekday counts from Sunday = 0.
    """
    daily = star.agg_daily_sales
    if stock_code is not None:
        chosen = star.dim_product.where(F.col("stock_code") == stock_code).select("product_key")
        daily = daily.join(chosen, "product_key")
    day = F.col("ds")
    return (
        daily.groupBy("date_key")
        .agg(
            money_sum(F.col("total_revenue")).alias("y"),
            F.sum("total_quantity").alias("units"),
            F.sum("num_orders").alias("orders"),
        )
        .select(
            day_of_key(F.col("date_key")).alias("ds"),
            "y",
            "units",
            "orders",
            (F.dayofweek(day) - 1).alias("day_of_week"),
            F.month(day).alias("month"),
        )
        .orderBy("ds")
    )


def daily_totals(star: Star) -> DataFrame:
    """Revenue, units and distinct invoices per day with sales: what a live day holds too."""
    daily = star.fact_sales.groupBy("date_key").agg(
        _revenue().alias("y"), F.sum("quantity").alias("units"), F.count_distinct("invoice").alias("orders")
    )
    return daily.select(day_of_key(F.col("date_key")).alias("ds"), "y", "units", "orders")


def daily_series_by_country(star: Star) -> DataFrame:
    """The daily series per country, each one a forecast input. Orders are distinct invoices."""
    daily = star.fact_sales.groupBy("geo_key", "date_key").agg(
        _revenue().alias("y"),
        F.sum("quantity").alias("units"),
        F.count_distinct("invoice").alias("orders"),
    )
    return daily.join(star.dim_geography, "geo_key").select(
        F.col("country").alias("series"), day_of_key(F.col("date_key")).alias("ds"),
        "y", "units", "orders",
    )


def daily_series_by_product(star: Star) -> DataFrame:
    """The daily series per product, straight from the daily aggregate."""
    return star.agg_daily_sales.join(
        star.dim_product.select("product_key", "stock_code"), "product_key"
    ).select(
        F.col("stock_code").alias("series"), day_of_key(F.col("date_key")).alias("ds"),
        F.col("total_revenue").alias("y"), F.col("total_quantity").alias("units"),
        F.col("num_orders").alias("orders"),
    )


def reorder_signals(star: Star, lookback_days: int = 30, rows: int | None = REORDER_ROWS) -> DataFrame:
    """Products whose units fell below 70 % of the window before, worst first; None gives all.

    Recent is the last ``lookback_days`` + 1 days of the calendar dimension, prior the
    ``lookback_days`` before. One conditional aggregation covers both windows. The bounds are
    scalar subqueries, so the scan skips the months and row groups before them.
    """
    newest = star.dim_date.agg(F.max("full_date").alias("day"))

    def bound(days: int, form: str):
        return newest.select(
            F.date_format(F.date_sub("day", days), form).cast("int")
        ).scalar()

    window_days = star.agg_daily_sales.where(
        (F.col("sale_month") >= bound(2 * lookback_days, "yyyyMM"))
        & (F.col("date_key") >= bound(2 * lookback_days, "yyyyMMdd"))
    )
    recent = F.col("date_key") >= bound(lookback_days, "yyyyMMdd")
    units = window_days.groupBy("product_key").agg(
        F.sum(F.when(recent, F.col("total_quantity"))).alias("recent_units"),
        F.sum(F.when(~recent, F.col("total_quantity"))).alias("prior_units"),
    )
    fallen = units.where(F.col("recent_units") < F.col("prior_units") * REORDER_BELOW).withColumn(
        "unit_change_pct", growth_pct(F.col("recent_units"), F.col("prior_units"))
    )
    if rows is not None:
        fallen = F.broadcast(fallen.orderBy("unit_change_pct", "product_key").limit(rows))
    return (
        star.dim_product.join(fallen, "product_key")
        .select(
            "stock_code", "description", "recent_units", "prior_units", "unit_change_pct",
            F.lit("REORDER").alias("signal"),
        )
        .orderBy("unit_change_pct", "stock_code")
    )


def cohort_retention(star: Star) -> DataFrame:
    """Active customers per cohort month and months since.

    The fact shrinks to one row per customer and month first, so also a customer with a third
    of all sales (the guests) has at most one row per month in the window.
    """
    month = F.to_date(F.date_trunc("month", F.col("invoice_date")))
    active = star.fact_sales.select("customer_key", month.alias("activity_month")).distinct()
    first = F.min("activity_month").over(Window.partitionBy("customer_key"))
    offset = (F.year("activity_month") - F.year("cohort_month")) * 12 + (
        F.month("activity_month") - F.month("cohort_month")
    )
    return (
        active.withColumn("cohort_month", first)
        .groupBy("cohort_month", offset.alias("month_number"))
        .agg(F.count("*").alias("active_customers"))
        .orderBy("cohort_month", "month_number")
    )


def product_revenue(star: Star) -> DataFrame:
    """Revenue and units per product description and price band."""
    by_product = star.fact_sales.groupBy("product_key").agg(
        F.sum(cents(F.col("revenue"))).alias("spent"), F.sum("quantity").alias("units")
    )
    return (
        by_product.join(
            star.dim_product.select("product_key", "description", "price_band"), "product_key"
        )
        .groupBy("description", "price_band")
        .agg((F.sum("spent") / 100.0).alias("revenue"), F.sum("units").alias("units"))
    )


def revenue_by_product(star: Star, n: int = TOP_ASKED) -> DataFrame:
    return (
        product_revenue(star)
        .groupBy("description")
        .agg(money_sum(F.col("revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), "description")
        .limit(n)
    )


def revenue_by_month(star: Star) -> DataFrame:
    months = star.fact_sales.groupBy("sale_month").agg(_revenue().alias("revenue"))
    return (
        months.join(_months(star), "sale_month")
        .orderBy("year", "month")
        .select("year", "month_name", "revenue")
    )


def revenue_by_country(star: Star, n: int | None = TOP_COUNTRIES) -> DataFrame:
    """The best countries; None gives all."""
    countries = star.fact_sales.groupBy("geo_key").agg(_revenue().alias("revenue"))
    ranked = (
        countries.join(star.dim_geography, "geo_key")
        .select("country", "revenue")
        .orderBy(F.desc("revenue"), "country")
    )
    return ranked if n is None else ranked.limit(n)


def revenue_by_segment(star: Star) -> DataFrame:
    return customer_rfm_summary(star).select(
        "customer_segment",
        F.col("num_customers").alias("customers"),
        F.col("total_revenue").alias("revenue"),
    )


def revenue_kpis(star: Star) -> DataFrame:
    """Headline figures: table sizes, total revenue and orders, mean and best month."""
    fact_rows = star.fact_sales.agg(F.count("*")).scalar()
    daily_rows = star.agg_daily_sales.agg(F.count("*")).scalar()
    best = F.max_by("month_name", F.struct(F.col("revenue"), -F.col("sale_month")))
    return monthly_revenue(star).agg(
        fact_rows.alias("fact_rows"),
        daily_rows.alias("daily_rows"),
        money_sum(F.col("revenue")).alias("total_revenue"),
        F.sum("orders").alias("total_orders"),
        F.round(money_sum(F.col("revenue")) / F.count("*"), 2).alias("avg_monthly_revenue"),
        best.alias("peak_month"),
    )
