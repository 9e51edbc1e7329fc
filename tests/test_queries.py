from pyspark.sql import functions as F

from tests.helpers import sale, star_of, values
from tillstream.plans import alerts, revenue, summaries


def month(invoice, when, price, **more):
    return sale(invoice, when=f"{when} 12:00:00", price=price, **more)


def test_first_month_has_no_growth(spark):
    made = star_of(spark, [month("1", "2020-01-05", 100), month("2", "2020-02-05", 150.01)])
    rows = values(revenue.monthly_revenue_trend(made), "month_name", "revenue", "prev_revenue", "mom_growth_pct")
    assert rows == [("January", 100.0, None, None), ("February", 150.01, 100.0, 50.01)]


def test_growth_after_a_month_without_revenue_is_null(spark):
    rows = spark.createDataFrame([(0.0, 5.0)], "before double, now double")
    from tillstream.functions.columns import growth_pct
    assert rows.select(growth_pct(F.col("now"), F.col("before"))).first()[0] is None


def test_equal_revenue_gives_equal_rank(spark):
    rows = [sale("1", code="A", price=9), sale("2", code="B", price=9), sale("3", code="C", price=1)]
    top = revenue.top_products(star_of(spark, rows), 3)
    assert values(top, "stock_code", "revenue_rank") == [("A", 1), ("B", 1), ("C", 3)]
    assert values(revenue.top_products(star_of(spark, rows), 1), "stock_code") == [("A",)]


def test_segment_rows_count_lines(spark):
    rows = [sale("1", customer="a"), sale("1", customer="a"), sale("2", customer=None)]
    got = revenue.customer_rfm_summary(star_of(spark, rows))
    assert sorted(values(got, "customer_segment", "num_customers", "distinct_customers", "revenue_share_pct")) == [
        ("LOW", 1, 1, 33.33), ("MID", 2, 1, 66.67),
    ]


def reorder_star(spark, *lines):
    """``lines`` are (code, date, units)."""
    return star_of(spark, [
        sale(str(i), code=code, when=f"{day} 08:00:00", quantity=units)
        for i, (code, day, units) in enumerate(lines)
    ])


def test_reorder_window_edges(spark):
    # The newest day is 2020-03-31: recent from 03-01 on, prior from 01-31 to 02-29.
    made = reorder_star(
        spark,
        ("Z", "2020-03-31", 1),
        ("A", "2020-03-01", 6), ("A", "2020-02-29", 10),
        ("B", "2020-03-31", 7), ("B", "2020-01-31", 10),
        ("C", "2020-03-31", 1), ("C", "2020-01-30", 10),
        ("D", "2020-02-10", 10),
    )
    got = revenue.reorder_signals(made)
    assert values(got, "stock_code", "recent_units", "prior_units", "unit_change_pct", "signal") == [
        ("A", 6, 10, -40.0, "REORDER")
    ]


def test_urgency_edges(spark):
    signals = spark.createDataFrame(
        [("a", "A", -40.0), ("b", "B", -40.01), ("c", "C", -45.25)],
        "description string, stock_code string, unit_change_pct double",
    )
    got = alerts.reorder_alerts(signals)
    assert values(got, "stock_code", "urgency") == [("A", "MEDIUM"), ("B", "HIGH"), ("C", "HIGH")]
    assert got.collect()[2]["message"] == (
        "⚠️  REORDER ALERT: 'c' sales dropped 45.2% vs prior period. Immediate restocking recommended."
    )
    assert alerts.reorder_alert_counts(got).first().asDict() == {"alert_count": 3, "high_urgency": 2}


def test_anomaly_edges(spark):
    trend = spark.createDataFrame(
        [(2020, "May", 1500.5, 50.0), (2020, "June", 1500.5, 50.01), (2020, "July", 99.0, -50.01),
         (2020, "August", 1.0, None)],
        "year int, month_name string, revenue double, mom_growth_pct double",
    )
    got = alerts.anomaly_alerts(trend)
    assert values(got, "period", "alert_type", "message") == [
        ("June 2020", "SPIKE", "📈 SPIKE: June 2020 showed 50.0% growth (£1,500.50)"),
        ("July 2020", "DROP", "📉 DROP: July 2020 showed 50.0% decline (£99.00)"),
    ]


def test_cohorts(spark):
    rows = [
        sale("1", customer="a", when="2020-01-05 00:00:00"),
        sale("2", customer="a", when="2020-03-05 00:00:00"),
        sale("3", customer="b", when="2020-01-09 00:00:00"),
        sale("4", customer="b", when="2020-01-10 00:00:00"),
        sale("5", customer="c", when="2021-01-10 00:00:00"),
    ]
    got = [(str(a), b, c) for a, b, c in values(
        revenue.cohort_retention(star_of(spark, rows)), "cohort_month", "month_number", "active_customers")]
    assert got == [("2020-01-01", 0, 2), ("2020-01-01", 2, 1), ("2021-01-01", 0, 1)]


def test_daily_series_of_one_product(spark):
    rows = [sale("1", code="A"), sale("1", code="B"), sale("2", code="A", when="2020-01-05 01:00:00")]
    made = star_of(spark, rows)
    total = values(revenue.daily_sales_series(made), "y", "orders", "day_of_week")
    assert total == [(10.0, 2, 3), (5.0, 1, 0)]  # a Wednesday and a Sunday
    assert values(revenue.daily_sales_series(made, "B"), "y", "orders") == [(5.0, 1)]
    assert revenue.daily_sales_series(made, "none' OR '1'='1").count() == 0


def test_summaries_of_empty_results(spark):
    empty = star_of(spark, [sale()])
    signals = revenue.reorder_signals(empty)
    assert summaries.query_summary(signals, "reorder_signals").first()["summary"] == "No data available."
    kpis = revenue.revenue_kpis(empty).first()
    assert (kpis["fact_rows"], kpis["peak_month"]) == (1, "January")


def test_insight_context(spark):
    rows = [sale(str(i), code=f"P{i:02}", price=i + 1) for i in range(12)]
    top = revenue.top_products(star_of(spark, rows)).select("stock_code", "total_units")
    got = alerts.insight_records(top, "top_products", ["stock_code"]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 11))
    assert got[0]["context"] == '{"stock_code":"P00","total_units":1}' and got[5]["context"] is None


def test_reorder_scan_reads_only_needed_months(spark):
    made = reorder_star(spark, ("A", "2020-03-31", 1), ("A", "2019-03-31", 1))
    plan = revenue.reorder_signals(made)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_month" in plan
    assert "SortMergeJoin" not in plan
