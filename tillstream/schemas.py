"""Explicit schemas of the raw file, the live events and the live tables.

Sale times carry no zone, so they are ``timestamp_ntz`` everywhere but on the streaming
event-time column, where a watermark needs ``timestamp``.
"""

RAW_SALES = (
    "Invoice string, StockCode string, Description string, Quantity double, "
    "InvoiceDate timestamp_ntz, Price double, `Customer ID` string, Country string"
)

CLEAN_SALES = (
    "Invoice string, StockCode string, Description string, Quantity double, "
    "InvoiceDate timestamp_ntz, Price double, CustomerID string, Country string, "
    "Revenue double, Year int, Month int"
)

LIVE_EVENT = (
    "invoice string, stock_code string, description string, quantity double, price double, "
    "revenue double, customer_id string, country string, invoice_date string, "
    "simulated_day string, day_index int, is_day_start boolean, is_day_end boolean, "
    "row_in_day long, total_in_day long"
)

HOT_EVENT = (
    "invoice string, stock_code string, description string, quantity double, price double, "
    "revenue double, customer_id string, country string, invoice_date timestamp, "
    "simulated_day date, row_in_day long, ingested_at timestamp, sale_month int"
)

FORECAST = (
    "simulated_day date, predicted_revenue double, lower_ci double, upper_ci double, "
    "generated_at timestamp"
)

OUTLOOK = (
    "generated_day date, forecast_date date, predicted_revenue double, lower_ci double, "
    "upper_ci double"
)

STATUS = (
    "id int, current_day date, total_rows long, days_streamed long, mape double, "
    "started_at timestamp"
)

# Stored warehouse tables; the two large ones are partitioned by sale_month (yyyymm).
WAREHOUSE = {
    "dim_date": (
        "date_key int, full_date date, year int, quarter int, month int, month_name string, "
        "week int, day_of_month int, day_of_week int, day_name string, is_weekend boolean"
    ),
    "dim_product": (
        "product_key long, stock_code string, description string, price_band string, "
        "unit_price double"
    ),
    "dim_customer": (
        "customer_key long, customer_id string, first_seen date, last_seen date, country string, "
        "customer_segment string"
    ),
    "dim_geography": "geo_key long, country string, region string",
    "fact_sales": (
        "sale_id long, invoice string, date_key int, product_key long, customer_key long, "
        "geo_key long, quantity long, unit_price double, revenue double, "
        "invoice_date timestamp_ntz, sale_month int"
    ),
    "agg_daily_sales": (
        "date_key int, product_key long, total_quantity long, total_revenue double, "
        "num_orders long, sale_month int"
    ),
}
