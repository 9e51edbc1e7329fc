"""Star schema: four dimensions, the sales fact and the daily aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions.columns import (
    GUEST,
    cents,
    customer_or_guest,
    date_key,
    month_key,
    money_sum,
    price_band,
    rfm_segment,
)
from tillstream.functions.regions import with_region
from tillstream.operators.keys import dense_key, short_origin
from tillstream.operators.lookup import lookup_key
from tillstream.session import written

# Weights of recency, frequency and monetary value in the customer score.
RECENCY_WEIGHT = 0.4
FREQUENCY_WEIGHT = 0.3
MONETARY_WEIGHT = 0.3
UNKNOWN_COUNTRY = "Unknown"
_ORIGIN = ["source_file", "source_row"]

# Rows per member, carried by freshly built dimensions for the fact build and not stored.
WEIGHT = "_rows"

DIM_PRODUCT = ["product_key", "stock_code", "description", "price_band", "unit_price"]
DIM_CUSTOMER = [
    "customer_key", "customer_id", "first_seen", "last_seen", "country", "customer_segment",
]
DIM_GEOGRAPHY = ["geo_key", "country", "region"]
FACT_SALES = [
    "sale_id", "invoice", "date_key", "product_key", "customer_key", "geo_key", "quantity",
    "unit_price", "revenue", "invoice_date",
]


@dataclass(frozen=True)
class Star:
    """The warehouse tables; ``fact_sales`` and ``agg_daily_sales`` also carry ``sale_month``."""

    dim_date: DataFrame
    dim_product: DataFrame
    dim_customer: DataFrame
    dim_geography: DataFrame
    fact_sales: DataFrame
    agg_daily_sales: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def build_dim_date(sales: DataFrame) -> DataFrame:
    """One row per day with sales; Monday is weekday 0, the week is the ISO week."""
    day = F.col("full_date")
    return (
        sales.select(F.to_date("InvoiceDate").alias("full_date"))
        .where(day.isNotNull())
        .distinct()
        .select(
            date_key(day).alias("date_key"),
            day,
            F.year(day).alias("year"),
            F.quarter(day).alias("quarter"),
            F.month(day).alias("month"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.weekofyear(day).alias("week"),
            F.dayofmonth(day).alias("day_of_month"),
            F.weekday(day).alias("day_of_week"),
            F.date_format(day, "EEEE").alias("day_name"),
            (F.weekday(day) >= 5).alias("is_weekend"),
        )
    )


# Keys whose newest times are broadcast, some 30 MB; more keys meet the sales by a shuffle.
MOST_BROADCAST = 250_000


def _at_newest(sales: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    """The sales of each key at its newest time: few rows, which alone are compared further.

    ``newest`` has a row per key with ``newest``. Both come from aggregates over numbers, which hash;
    comparing whole rows by structs would sort the lake. A small ``newest`` is broadcast, else both sides are
    dealt by key and time, which a frequent key does not skew.
    """
    at = newest.select(F.col(key).alias("_key"), F.col("newest").alias("_newest"))
    return sales.join(at, F.col(key).eqNullSafe(F.col("_key")) & F.col("InvoiceDate").eqNullSafe(F.col("_newest"))).drop(
        "_key", "_newest")


def build_dim_product(sales: DataFrame) -> DataFrame:
    """Latest description and price per stock code, keys in code order.

    The latest sale is that of the newest time, then the largest by invoice, description, price, quantity
    and country: a total order.
    """
    coded = sales.where(F.col("StockCode").isNotNull())
    newest = coded.groupBy("StockCode").agg(F.max("InvoiceDate").alias("newest"), F.count("*").alias(WEIGHT))
    newest = written(newest, "product-times")  # a row per product, read twice
    known = F.broadcast(newest) if newest.count() <= MOST_BROADCAST else newest
    order = F.struct("Invoice", "Description", "Price", "Quantity", "Country")
    last = _at_newest(coded, known, "StockCode").groupBy("StockCode").agg(F.max(order).alias("last"))
    products = last.join(newest, "StockCode").select(
        F.col("StockCode").alias("stock_code"),
        F.col("last.Description").alias("description"),
        price_band(F.col("last.Price")).alias("price_band"),
        F.col("last.Price").alias("unit_price"),
        WEIGHT,
    )
    return dense_key(products, ["stock_code"], "product_key").select(*DIM_PRODUCT, WEIGHT)


def _customer_measures(sales: DataFrame) -> DataFrame:
    """Times, invoices, money, newest known country and rows per customer.

    Sums per customer, invoice and country come first, so that counting invoices needs no sets and the newest
    country is found among a few rows per invoice.
    """
    named = sales.withColumn("customer_id", customer_or_guest(F.col("CustomerID")))
    by_country = named.groupBy("customer_id", "Invoice", "Country").agg(
        F.min("InvoiceDate").alias("first_at"),
        F.max("InvoiceDate").alias("last_at"),
        F.sum(cents(F.col("Revenue"))).alias("cents"),
        F.count("*").alias(WEIGHT),
    )
    # A few rows per invoice, stored because they are read twice.
    by_country = written(by_country, "customer-invoices")
    by_invoice = by_country.groupBy("customer_id", "Invoice").agg(
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max(F.when(F.col("Country").isNotNull(), F.col("last_at"))).alias("newest"),
        F.sum("cents").alias("cents"),
        F.sum(WEIGHT).alias(WEIGHT),
    )
    measures = by_invoice.groupBy("customer_id").agg(
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.count("Invoice").alias("frequency"),
        (F.sum("cents") / F.lit(100.0)).alias("monetary"),
        F.max("newest").alias("newest"),
        F.sum(WEIGHT).alias(WEIGHT),
    )
    placed = by_country.where(F.col("Country").isNotNull()).withColumn("InvoiceDate", F.col("last_at"))
    last = _at_newest(placed, measures, "customer_id").groupBy("customer_id").agg(
        F.max(F.struct("Invoice", "Country")).alias("last")
    )
    return measures.join(last, "customer_id", "left").select(
        "customer_id", "first_at", "last_at", "frequency", "monetary", F.col("last.Country").alias("country"), WEIGHT
    )


def customer_scores(sales: DataFrame) -> DataFrame:
    """Recency, frequency, monetary value and their weighted 0-1 score per known customer.

    Guests are one row without a score. Each measure is scaled by its smallest and largest
    value over all customers, and counts 0.5 where those are equal. The measures are stored
    once, so that finding the limits does not aggregate the sales again.
    """
    measures = written(_customer_measures(sales), "customer-measures")
    known = F.col("customer_id") != GUEST

    def limit(of, name: str) -> Column:
        return of(F.when(known, F.col(name)))

    # One row of limits; the oldest last sale is the largest recency.
    bounds = measures.agg(
        F.struct(
            F.max("last_at").alias("newest"),
            limit(F.max, "last_at").alias("late"), limit(F.min, "last_at").alias("early"),
            limit(F.min, "frequency").alias("rare"), limit(F.max, "frequency").alias("often"),
            limit(F.min, "monetary").alias("little"), limit(F.max, "monetary").alias("much"),
        )
    ).scalar()

    def age(since: Column) -> Column:
        return F.timestamp_diff("DAY", since, bounds["newest"])

    def scaled(value: Column, low: Column, high: Column) -> Column:
        return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.5))

    score = (
        (1 - scaled(age(F.col("last_at")), age(bounds["late"]), age(bounds["early"])))
        * RECENCY_WEIGHT
        + scaled(F.col("frequency"), bounds["rare"], bounds["often"]) * FREQUENCY_WEIGHT
        + scaled(F.col("monetary"), bounds["little"], bounds["much"]) * MONETARY_WEIGHT
    )
    return measures.withColumns(
        {"recency": age(F.col("last_at")), "rfm_score": F.when(known, score)}
    )


def build_dim_customer(sales: DataFrame) -> DataFrame:
    """Customers with segment, keys in id order, and the guest row with the last key."""
    scores = customer_scores(sales)
    is_guest = F.col("customer_id") == GUEST
    members = scores.where(~is_guest).select(
        F.lit(False).alias("guest"),
        "customer_id",
        F.to_date("first_at").alias("first_seen"),
        F.to_date("last_at").alias("last_seen"),
        "country",
        rfm_segment(F.col("rfm_score")).alias("customer_segment"),
        WEIGHT,
    )
    # The guest row exists also when every buyer is known.
    guest = scores.agg(F.coalesce(F.max(F.when(is_guest, F.col(WEIGHT))), F.lit(0)).alias(WEIGHT)).select(
        F.lit(True).alias("guest"),
        F.lit(GUEST).alias("customer_id"),
        F.lit(None).cast("date").alias("first_seen"),
        F.lit(None).cast("date").alias("last_seen"),
        F.lit(UNKNOWN_COUNTRY).alias("country"),
        F.lit("LOW").alias("customer_segment"),
        WEIGHT,
    )
    return dense_key(
        members.unionByName(guest), ["guest", "customer_id"], "customer_key"
    ).select(*DIM_CUSTOMER, WEIGHT)


def build_dim_geography(sales: DataFrame, regions: DataFrame) -> DataFrame:
    """Countries seen, keys in name order, with their region."""
    countries = (
        sales.where(F.col("Country").isNotNull())
        .groupBy(F.col("Country").alias("country"))
        .agg(F.count("*").alias(WEIGHT))
    )
    return dense_key(with_region(countries, regions), ["country"], "geo_key").select(
        *DIM_GEOGRAPHY, WEIGHT
    )


def fact_rows(sales: DataFrame) -> DataFrame:
    """The sales that enter the fact. A row without date or product is dropped."""
    rows = sales.where(F.col("InvoiceDate").isNotNull() & F.col("StockCode").isNotNull()).select(
        F.col("Invoice").alias("invoice"),
        F.col("StockCode").alias("stock_code"),
        customer_or_guest(F.col("CustomerID")).alias("customer_id"),
        F.col("Country").alias("country"),
        F.col("Quantity").cast("long").alias("quantity"),
        F.col("Price").alias("unit_price"),
        F.col("Revenue").alias("revenue"),
        F.col("InvoiceDate").alias("invoice_date"),
        *[c for c in _ORIGIN if c in sales.columns],
    )
    return short_origin(rows)


def build_fact_sales(
    sales: DataFrame, product: DataFrame, customer: DataFrame, geography: DataFrame
) -> DataFrame:
    """The numbered fact, in the order of its numbers. ``sales`` comes from ``read_lake(..., with_row_id=True)``.

    Rows get the keys of products and customers, then a number, then the key of their country; one without
    country keeps a null ``geo_key``. Dimension keys rise with the values they stand for, guests last, so the order
    is that by these values. The date key is computed from the day, which needs no join. Rows that are numbered
    last lie by time, so storing them by month deals them out no more.
    """
    rows = fact_rows(sales)
    num_rows = product.agg(F.sum(WEIGHT)).first()[0] or 0
    rows = lookup_key(rows, product, "stock_code", "product_key", WEIGHT, num_rows).drop("stock_code")
    rows = lookup_key(rows, customer, "customer_id", "customer_key", WEIGHT, num_rows).drop("customer_id")
    origin = [c for c in _ORIGIN if c in rows.columns]
    order = ["invoice_date", "invoice", "product_key", "customer_key", "country", "quantity", "unit_price", *origin]
    rows = dense_key(rows, order, "sale_id", origin)
    rows = lookup_key(rows, geography, "country", "geo_key", WEIGHT, num_rows)
    return rows.withColumn("date_key", date_key(F.to_date("invoice_date"))).select(*FACT_SALES)


def build_agg_daily(fact: DataFrame) -> DataFrame:
    """Units, revenue and distinct invoices per day and product."""
    return _daily(fact)


def _daily(fact: DataFrame, *further: str) -> DataFrame:
    return fact.groupBy(*further, "date_key", "product_key").agg(
        F.sum("quantity").alias("total_quantity"),
        money_sum(F.col("revenue")).alias("total_revenue"),
        F.count_distinct("invoice").alias("num_orders"),
    )


# Sales of one day that one task counts, and of a month that go to one task where its days allow it.
MOST_OF_DAY = 2_000_000


def build_agg_daily_by_month(fact: DataFrame) -> DataFrame:
    """``build_agg_daily`` with ``sale_month``, dealt by month so that it is stored without a further shuffle.

    Sales are dealt once, by month and, where a month has very many, by groups of its days; all of a day's figures
    are then counted where they are. Days with more than ``MOST_OF_DAY`` sales are counted in two phases instead, which
    spread over many tasks.
    """
    rows = with_sale_month(fact)
    days = rows.groupBy("sale_month", "date_key").agg(F.count("*").alias("n")).collect()  # a row per day
    large = [d["date_key"] for d in days if d["n"] > MOST_OF_DAY]
    months: dict[int, int] = {}
    for d in days:
        if d["n"] <= MOST_OF_DAY:
            months[d["sale_month"]] = months.get(d["sale_month"], 0) + d["n"]
    groups = max(1, -(-max(months.values(), default=0) // MOST_OF_DAY))
    is_large = F.coalesce(F.col("date_key").isin(large), F.lit(False))
    dealt = ["sale_month", "_group"]
    small = rows.where(~is_large).withColumn("_group", F.pmod("date_key", F.lit(groups))).select(
        *dealt, "date_key", "product_key", "quantity", "revenue", "invoice"
    )
    counted = _daily(small.repartition(*dealt), *dealt).drop("_group")
    if not large:
        return counted
    spread = with_sale_month(build_agg_daily(rows.where(is_large))).hint("rebalance", "sale_month")
    return counted.unionByName(spread)


def with_sale_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sale_month", month_key(F.col("date_key")))
