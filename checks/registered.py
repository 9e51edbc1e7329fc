"""The registered queries: name to (session, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import feeds
from tillstream.functions.columns import (
    customer_or_guest,
    money_sum,
    price_band,
    rfm_segment,
)
from tillstream.functions.regions import with_region
from tillstream.operators import checks as constraint_checks
from tillstream.operators import forecast, series, star, text
from tillstream.operators.clean import clean_sales, cleaning_report
from tillstream.operators.keys import dense_key
from tillstream.operators.similarity import recall, top_k_by_projections, top_k_similar
from tillstream.plans import alerts, live, revenue, summaries
from tillstream.session import new_folder, written
from tillstream.sources import lake, warehouse
from tillstream.sources.events import message_counts, parse_events, read_event_files
from tillstream.sources.live_store import LiveStore
from tillstream.sources.tables import write_json
from tillstream.streaming.forecasts import forecast_on_day_start
from tillstream.streaming.live import (
    DAY_SCHEMA,
    batch_sizes,
    close_days,
    day_progress,
    day_totals,
    drain,
    recent_ring,
    running_kpis,
    start,
    throughput,
    window_counts,
    with_open,
    write_hot_events,
)

Query = Callable[[SparkSession, str], DataFrame]


def _c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.sales(spark, sf_dir).groupBy(price_band(F.col("Price")).alias("price_band")).agg(
        F.count("*").alias("num_lines"), money_sum(F.col("Revenue")).alias("revenue")
    )


def _c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = star.customer_scores(feeds.sales(spark, sf_dir))
    return scores.where(F.col("rfm_score").isNotNull()).select(
        "customer_id", "recency", "frequency", "monetary",
        F.round("rfm_score", 6).alias("rfm_score"),
        rfm_segment(F.col("rfm_score")).alias("customer_segment"),
    )


def _c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    countries = feeds.sales(spark, sf_dir).select(F.col("Country").alias("country")).distinct()
    return with_region(countries, feeds.regions(spark, sf_dir))


def _c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        feeds.sales(spark, sf_dir)
        .groupBy(customer_or_guest(F.col("CustomerID")).alias("customer_id"))
        .agg(F.count("*").alias("num_lines"))
    )


def _c5_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a folder in which sales of one country to some customers have a field too many, and
    those of another a quantity that is no number."""
    path = feeds.faulty_csv_dir(spark, sf_dir)
    return cleaning_report(
        lake.read_sales_csv(spark, path, header=False), lake.rejected_lines(spark, path, header=False)
    )


def _s1_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.rejected_lines(spark, feeds.faulty_csv_dir(spark, sf_dir), header=False).groupBy("reason", "kept").agg(
        F.count("*").alias("num_lines"), F.count_distinct("line").alias("num_texts")
    )


def _a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = revenue.top_products(feeds.star(spark, sf_dir)).select(
        "stock_code", "description", "total_units",
        F.col("total_revenue").cast("decimal(18,2)").alias("total_revenue"),
    )
    return alerts.insight_records(top, "top_products", [F.desc("total_revenue"), "stock_code"])


# Groups of rows, by hash, that are compared as a whole.
_ROW_GROUPS = 4096


def apart(both: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``num_rows`` with ``side`` 1, and ``differing``, the rows of either side (1 or -1) without their
    counterpart on the other; equal rows count as often as they are there.

    Rows are added up by groups, as sums of two 64-bit hashes, so that tables that agree are not shuffled. The rows of
    groups whose sums or numbers of rows differ are then compared in full.
    """
    # Hashing skips nulls, so whether a value is null is hashed too.
    values = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    hashed = both.withColumns({"_h1": F.xxhash64(F.lit(1), *values), "_h2": F.xxhash64(F.lit(2), *values)}).withColumn(
        "_group", F.pmod("_h1", F.lit(_ROW_GROUPS))
    )
    halves = [half for h in ("_h1", "_h2") for half in (F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(h, 32))]
    sums = {f"_s{i}": F.sum(F.col("side") * half) for i, half in enumerate(halves)}
    groups = written(
        hashed.groupBy("_group").agg(
            F.count_if(F.col("side") == 1).alias("held"), F.sum("side").alias("_s"), *[s.alias(n) for n, s in sums.items()]
        ), "row-groups",
    )
    differ = groups.where(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in ("_s", *sums)])).select("_group")
    suspect = hashed.join(F.broadcast(differ), "_group", "left_semi")
    exact = suspect.groupBy(*columns).agg(F.sum("side").alias("apart")).agg(
        F.coalesce(F.sum(F.abs("apart")), F.lit(0)).alias("differing")
    )
    return groups.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("num_rows")).crossJoin(F.broadcast(exact))


def _s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the six tables after two loads into one folder, and rows that differ from another load."""
    path = new_folder(spark, "warehouse-twice")
    for _ in range(2):
        again = warehouse.load_warehouse(feeds.sales(spark, sf_dir, with_row_id=True), feeds.regions(spark, sf_dir), path)
    first = feeds.star(spark, sf_dir).tables()

    def differing(name: str, rows: DataFrame) -> DataFrame:
        # Rows of either load, without their counterpart in the other.
        both = rows.withColumn("side", F.lit(1)).unionByName(first[name].withColumn("side", F.lit(-1)))
        found = apart(both, rows.columns)
        return found.select(F.lit(name).alias("table_name"), "num_rows", "differing")

    return reduce(DataFrame.unionByName, [differing(name, rows) for name, rows in again.tables().items()])


def on_star(plan: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: plan(feeds.star(spark, sf_dir), **options)


BATCH: dict[str, Query] = {
    "s1_read_sales_csv": lambda spark, d: lake.read_sales_csv(spark, feeds.csv_dir(spark, d)),
    "s1_rejected_lines": _s1_rejected,
    "s3_read_lake": lambda spark, d: lake.lake_summary(feeds.sales(spark, d)),
    "s4_ingest": lambda spark, d: feeds.sales(spark, d),
    "c1_clean_sales": lambda spark, d: clean_sales(
        lake.read_sales_csv(spark, feeds.csv_dir(spark, d))
    ),
    "c5_cleaning_report": lambda spark, d: cleaning_report(
        lake.read_sales_csv(spark, feeds.csv_dir(spark, d))
    ),
    "c5_report_with_rejects": _c5_rejects,
    "c7_price_band": _c7,
    "c8_rfm_scores": _c8,
    "c9_region_of_country": _c9,
    "c10_customer_or_guest": _c10,
    "d1_dim_date": lambda spark, d: star.build_dim_date(feeds.sales(spark, d)),
    "d2_dim_product": on_star(lambda s: s.dim_product),
    "d3_dim_customer": on_star(lambda s: s.dim_customer),
    "d4_dim_geography": on_star(lambda s: s.dim_geography),
    "d5_fact_sales": on_star(lambda s: s.fact_sales.drop("sale_month")),
    "d6_dense_key": lambda spark, d: _d6(spark, d),
    "d7_agg_daily_sales": on_star(lambda s: s.agg_daily_sales.drop("sale_month")),
    "d8_table_counts": on_star(warehouse.table_counts),
    "s5_load_warehouse": lambda spark, d: _s5(spark, d),
    "d9_check_constraints": on_star(constraint_checks.check_constraints),
    "q1_monthly_revenue_trend": on_star(revenue.monthly_revenue_trend),
    "q2_top_products": on_star(revenue.top_products),
    "q3_customer_rfm_summary": on_star(revenue.customer_rfm_summary),
    "q4_geo_revenue": on_star(revenue.geo_revenue),
    "q5_daily_sales_series": on_star(revenue.daily_sales_series),
    "q5_daily_sales_series_by_country": on_star(revenue.daily_series_by_country),
    "q5_daily_sales_series_by_product": on_star(revenue.daily_series_by_product),
    "q6_reorder_signals": on_star(revenue.reorder_signals),
    "q7_cohort_retention": on_star(revenue.cohort_retention),
    "q8_revenue_by_product": on_star(revenue.revenue_by_product),
    "q9_revenue_by_month": on_star(revenue.revenue_by_month),
    "q10_revenue_by_country": on_star(revenue.revenue_by_country),
    "q11_revenue_by_segment": on_star(revenue.revenue_by_segment),
    "q12_revenue_kpis": on_star(revenue.revenue_kpis),
    "q13_query_summaries": on_star(summaries.query_summaries),
    "q14_segment_mix": on_star(revenue.segment_mix),
    "a1_reorder_alerts": on_star(lambda s: alerts.reorder_alerts(revenue.reorder_signals(s, rows=None))),
    "a1_reorder_alert_counts": on_star(
        lambda s: alerts.reorder_alert_counts(alerts.reorder_alerts(revenue.reorder_signals(s, rows=None)))
    ),
    "a2_anomaly_alerts": on_star(lambda s: alerts.anomaly_alerts(revenue.monthly_revenue_trend(s))),
    "a4_insight_records": _a4,
}


def _new_store(spark: SparkSession) -> LiveStore:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return LiveStore(spark, new_folder(spark, "live-run"))


def _stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    pieces = files_per_batch and files_per_batch * feeds.event_pieces(spark, sf_dir)
    return read_event_files(spark, feeds.event_dir(spark, sf_dir), pieces)


def _hot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.hot(spark, sf_dir).select(
        "invoice", "stock_code", "description", "quantity", "price", "revenue", "customer_id",
        "country", F.col("invoice_date").cast("timestamp_ntz").alias("invoice_date"),
        "simulated_day", "row_in_day",
    )


def _s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition after all sales were stored and those of 1997 were stored again."""
    path = new_folder(spark, "lake")
    sales = feeds.sales(spark, sf_dir)
    lake.write_lake(sales, path)
    lake.write_lake(sales.where(F.col("Year") == 1997), path)
    return lake.read_lake(spark, path).groupBy("Year", "Month").agg(
        F.count("*").alias("num_rows"), money_sum(F.col("Revenue")).alias("revenue")
    )


def _s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed stream, stored as it was read."""
    store = _new_store(spark)
    events = _stream(spark, sf_dir)
    writer = events.writeStream.format("parquet").option("path", store.hot_path)
    drain(start(writer, store.checkpoint("events"), once=True))
    return _event_columns(spark.read.schema(events.schema).parquet(store.hot_path))


def _s6_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed together with all conversation turns, which are no events."""
    turns = feeds.table(spark, sf_dir, "conversations").select(F.col("text").alias("value"))
    return message_counts(spark.read.text(feeds.event_dir(spark, sf_dir)).unionByName(turns))


def _s7_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hot table, its first months rewritten after a first part of the feed, read with the rest, of
    which one day is of these months; and the folders that the rewriting should have deleted."""
    store, folder = _new_store(spark), new_folder(spark, "feed")
    messages = spark.read.text(feeds.event_dir(spark, sf_dir))
    sold = F.get_json_object("value", "$.simulated_day")
    early = (sold < "1998") & (sold != "1995-05-05")
    for part in (early, ~early):
        messages.where(part).write.mode("append").options(**feeds.COMPRESSED).text(folder)
        events = read_event_files(spark, folder)
        drain(write_hot_events(events, store.hot_path, store.checkpoint("hot"), once=True))
        if part is early:
            store.hot_table().close_months(199801)
    store.hot_table().close_months(199801)
    return store.hot().groupBy("simulated_day").agg(
        F.count("*").alias("num_events"), money_sum(F.col("revenue")).alias("revenue")
    ).withColumn("stale_folders", F.lit(store.hot_table().stale_folders()).cast("long"))


def _d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.table(spark, sf_dir, "events").select("event_type", "event_id")
    return dense_key(events, ["event_type", "event_id"], "event_key")


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "invoice", "stock_code", "customer_id", "revenue", "simulated_day", "day_index",
        "row_in_day", "total_in_day", "is_day_start", "is_day_end",
        F.col("invoice_date").cast("timestamp_ntz").alias("invoice_date"),
    )


def _events_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of the feed, parsed by the same code that parses the stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _event_columns(parse_events(spark.read.text(feeds.event_dir(spark, sf_dir))))


def _s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch has all forecasts and newer ones, doubled, of the last 400 days; a batch of another
    run, sent twice, has tripled ones of the last 100."""
    table = _new_store(spark).forecasts()
    made = feeds.forecasts(spark, sf_dir)
    newest = made.agg(F.max("simulated_day")).scalar()

    def last(days: int, factor: int) -> DataFrame:
        stamp = F.lit(f"2000-01-0{factor} 00:00:00").cast("timestamp")
        return made.where(F.col("simulated_day") > F.date_sub(newest, days)).withColumns(
            {"predicted_revenue": F.col("predicted_revenue") * factor, "generated_at": stamp}
        )

    stamped = made.withColumn("generated_at", F.lit("2000-01-01 00:00:00").cast("timestamp"))
    table.write(last(400, 2).unionByName(stamped), "first-run", 0)
    table.write(last(100, 3), "second-run", 0)
    table.write(last(100, 3), "second-run", 0)
    return table.read().drop("generated_at")


def _s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.reorder_alerts(revenue.reorder_signals(feeds.star(spark, sf_dir), rows=None))
    path = new_folder(spark, "alerts")
    write_json(found, path)
    return spark.read.schema(found.schema).json(path)


def _s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the live tables before and after a reset, and the files that are left."""
    store = _new_store(spark)
    drain(write_hot_events(_stream(spark, sf_dir), store.hot_path, store.checkpoint("hot"), once=True))
    made = feeds.forecasts(spark, sf_dir)
    store.forecasts().write(made)
    store.outlook().write(feeds.simple_outlook(made))
    table = store.hot_table()
    store.status().write(live.stream_status(table.counters(), live.mean_error(made, table.day_counts())))

    def sizes(column: str) -> DataFrame:
        tables = {
            "hot": store.hot(), "forecasts": store.forecasts().read(),
            "outlook": store.outlook().read(), "status": store.status().read(),
        }
        counted = reduce(
            DataFrame.unionByName,
            [
                rows.agg(F.count("*").alias(column)).withColumn("table_name", F.lit(name))
                for name, rows in tables.items()
            ],
        )
        return written(counted, "sizes")

    before = sizes("rows_before")
    store.reset()
    return before.join(sizes("rows_after"), "table_name").select(
        "table_name", "rows_before", "rows_after", F.lit(store.files()).cast("long").alias("files_left")
    )


def _t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark)
    drain(running_kpis(_stream(spark, sf_dir, 3), store.kpis(), store.checkpoint("kpis"), once=True))
    exact = feeds.hot(spark, sf_dir).agg(F.count_distinct("customer_id")).scalar()
    error = F.abs(F.col("unique_customers") - exact) / exact
    return store.kpis().read().withColumn("estimate_within_3_pct", error < 0.03).drop("unique_customers")


def _t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per second of the event table, which is read as a stream."""
    store = _new_store(spark)
    table = feeds.table(spark, sf_dir, "events")
    rows = (
        spark.readStream.schema(table.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select(F.col("ts").cast("timestamp").alias("ts"))
    )
    path = store.hot_path
    drain(throughput(rows, "ts", path, store.checkpoint("throughput"), once=True))
    times = table.select(F.col("ts").cast("timestamp").alias("ts"))
    closed = spark.read.schema("window_start timestamp, num_rows long").parquet(path)
    whole = with_open(
        closed, window_counts(times, "ts"), F.col("window_start") + F.expr("INTERVAL 1 second"),
        times.agg(F.max("ts")).scalar(), "10 seconds",
    )
    return whole.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed, then in a later batch the first five sales of its first day once more."""
    store, folder = _new_store(spark), new_folder(spark, "feed")
    messages = spark.read.text(feeds.event_dir(spark, sf_dir))

    def run() -> None:
        events = read_event_files(spark, folder)
        drain(recent_ring(events, store.recent(), store.checkpoint("recent"), once=True))

    messages.write.options(**feeds.COMPRESSED).text(folder)
    run()
    first = F.get_json_object("value", "$.day_index").cast("int") == 0
    few = messages.where(first & (F.get_json_object("value", "$.row_in_day").cast("int") < 5))
    few.write.mode("append").options(**feeds.COMPRESSED).text(folder)
    run()
    return store.recent().read().withColumn("invoice_date", F.col("invoice_date").cast("timestamp_ntz"))


def _t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark)
    drain(close_days(_stream(spark, sf_dir), store.closed_path, store.checkpoint("close"), once=True))
    closed = spark.read.schema(DAY_SCHEMA).parquet(store.closed_path)
    hot = feeds.hot(spark, sf_dir)
    end = F.date_add("simulated_day", 1).cast("timestamp")
    return with_open(closed, day_totals(hot), end, hot.agg(F.max("invoice_date")).scalar(), "1 hour")


def _t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark)
    path = store.hot_path
    drain(batch_sizes(_stream(spark, sf_dir, 1), path, store.checkpoint("sizes"), once=True))
    return (
        spark.read.schema("batch long, num_rows long").parquet(f"{path}/batch_*")
        .agg(F.count_if(F.col("num_rows") > 0).alias("num_batches"), F.sum("num_rows").alias("num_rows"))
    )


def _t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _new_store(spark)
    drain(day_progress(_stream(spark, sf_dir, 3), store.progress(), store.checkpoint("day"), once=True))
    return store.progress().read()


def _t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event counts once: the feed without the first sale of the tenth day, with sales that have no
    time; then after a restart that sale, which is late, the last twenty days once more, and sales without a
    time once more; then, after another restart, the tenth day."""
    store, folder = _new_store(spark), new_folder(spark, "feed")
    messages = spark.read.text(feeds.event_dir(spark, sf_dir))
    day, place = (F.get_json_object("value", f"$.{name}").cast("int") for name in ("day_index", "row_in_day"))
    newest = messages.agg(F.max(day)).scalar()
    late, untimed = (day == 9) & (place == 0), (day == 20) & (place % 2 == 0)
    no_time = F.regexp_replace("value", r'"invoice_date":"[^"]*"', '"invoice_date":"unknown"')
    sent = messages.select(F.when(untimed, no_time).otherwise(F.col("value")).alias("value"))
    for batch in (~late, late | (day > newest - 20) | untimed, day == 9):
        sent.where(batch).write.mode("append").options(**feeds.COMPRESSED).text(folder)
        events = read_event_files(spark, folder)
        drain(write_hot_events(events, store.hot_path, store.checkpoint("hot"), once=True, distinct=True))
    return store.hot().groupBy("simulated_day").agg(
        F.count("*").alias("num_events"), money_sum(F.col("revenue")).alias("revenue")
    )


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.mean_error(feeds.forecasts(spark, sf_dir), feeds.day_counts(spark, sf_dir))


def _l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse history with live days from 1999 on, before the newest day."""
    history = revenue.daily_totals(feeds.star(spark, sf_dir))
    days = live.live_daily_series(feeds.hot(spark, sf_dir)).where(F.col("ds") >= "1999-01-01")
    newest = history.agg(F.max("ds")).scalar()
    return live.can_forecast(live.merge_history(history, days, newest))


def _against_late(plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """Forecasts and current days of a feed with late events, both over a hot table that took in each event once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = feeds.late_store(spark, sf_dir).hot_table().day_counts()
        return plan(feeds.forecasts(spark, sf_dir, counts), live.current_days(feeds.closed_days(spark, sf_dir), counts))

    return run


def on_hot(plan: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: plan(feeds.hot(spark, sf_dir), **options)


LIVE: dict[str, Query] = {
    "c6_enrich_events": _events_read,
    "s2_write_lake": _s2,
    "s6_read_event_stream": _s6,
    "s6_rejected_messages": _s6_rejected,
    "s7_write_hot_events": _hot_rows,
    "s7_compact_hot": _s7_compacted,
    "s8_upsert": _s8,
    "s9_write_json": _s9,
    "s10_reset_live": _s10,
    "t1_running_kpis": _t1,
    "t2_throughput": _t2,
    "t3_recent_ring": _t3,
    "t4_close_days": _t4,
    "t5_micro_batches": _t5,
    "t6_day_progress": _t6,
    "t7_exactly_once": _t7,
    "l1_recent_transactions": lambda spark, d: live.recent_transactions(
        feeds.hot(spark, d), feeds.live_store(spark, d).hot_table().arrivals()
    ),
    "l2_live_top_products": on_hot(live.live_top_products),
    "l3_live_geo_revenue": on_hot(live.live_geo_revenue),
    "l4_live_daily_series": on_hot(live.live_daily_series),
    "l5_forecast_vs_actual": _against_late(live.forecast_vs_actual),
    "l6_forecast_outlook": lambda spark, d: live.forecast_outlook(
        feeds.simple_outlook(feeds.forecasts(spark, d))
    ),
    "l7_merge_history": _l7,
    "l8_accuracy_report": _against_late(live.accuracy_report),
    "l9_stream_status": lambda spark, d: live.stream_status(
        feeds.live_store(spark, d).hot_table().counters(), _accuracy(spark, d)
    ).drop("started_at"),
    "l10_accuracy_grade": _accuracy,
    "l11_top_product_share": on_hot(live.top_product_share),
}


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.daily_series(spark, sf_dir).where(F.col("series") == "total")


def _rounded(rows: DataFrame, names: list[str], digits: int = 8) -> DataFrame:
    return rows.withColumns({name: F.round(name, digits) for name in names})


def _f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.calendar_features(feeds.daily_series(spark, sf_dir)).select(
        "series", "ds", "dow", "month", "is_weekend", "dow_sin", "dow_cos", "month_sin", "month_cos"
    )
    return _rounded(rows, ["dow_sin", "dow_cos", "month_sin", "month_cos"])


def _f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.log_features(feeds.daily_series(spark, sf_dir))
    return _rounded(rows.select("series", "ds", "y", "units", "orders"), series.LOGGED)


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.features(feeds.daily_series(spark, sf_dir))
    return series.minmax_apply(rows, series.minmax_fit(rows))


def _f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled measures, and the revenue that undoing the scaling gives back."""
    daily = feeds.daily_series(spark, sf_dir)
    scales = series.minmax_fit(series.features(daily)).select("series", "y_scale")
    rows = _scaled(spark, sf_dir).join(scales, "series")
    return _rounded(
        rows.select(
            "series", "ds", "y", "units", "orders",
            F.round(series.to_money(F.col("y"), F.col("y_scale")), 2).alias("revenue"),
        ),
        series.LOGGED,
    )


def _f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of all series, each with its size and sums."""
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    ahead = F.aggregate("target", F.lit(0.0), lambda a, x: a + x)
    return series.sliding_samples(_scaled(spark, sf_dir)).select(
        "series", "ds", F.size("window").alias("num_inputs"), F.size("target").alias("num_targets"),
        F.round(total, 6).alias("input_sum"), F.round(ahead, 6).alias("target_sum"),
        F.round(F.get("window", F.lit(0)), 6).alias("oldest_input"),
    )


def _f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        series.chrono_split(feeds.daily_series(spark, sf_dir))
        .groupBy("series", "part")
        .agg(F.count("*").alias("num_rows"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"))
    )


def _f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the fit: its samples, and that one of the candidates was kept per day."""
    return feeds.forecaster(spark, sf_dir).weights.select(
        "step", F.size("weights").alias("num_weights"), "train_samples", "calibration_samples",
        F.col("regularisation").isin(*forecast.REGULARISATION).alias("is_candidate"),
        (F.col("calibration_loss") < 0.05).alias("loss_below_0_05"),
        F.col("rounds").between(2, forecast.MOST_ROUNDS).alias("robust_rounds"),
    )


def _f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the forecasts: their days and method, and the order of their bounds."""
    made = forecast.forecast(feeds.daily_series(spark, sf_dir), feeds.forecaster(spark, sf_dir))
    return made.select(
        "series", "origin", "ds", "method",
        ((F.col("lower_ci") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper_ci"))).alias("in_order"),
    )


def _f7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons that the model has not seen, and whether the bounds hold nine in ten of their totals, within
    three standard errors of what every seventh horizon, which shares no day with the next, would give."""
    daily = feeds.daily_series(spark, sf_dir)
    made = forecast.forecast(daily, feeds.forecaster(spark, sf_dir), forecast.scored_origins(daily))
    judged = forecast.evaluate_totals(made, daily)
    inside = F.sum(F.col("inside_bounds") * F.col("num_horizons")) / F.sum("num_horizons")
    error = F.sqrt(0.9 * 0.1 * series.HORIZON / F.sum("num_horizons"))
    return judged.agg(F.sum("num_horizons").alias("num_horizons"), (F.abs(inside - 0.9) <= 3 * error).alias("bounds_hold"))


def _f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = feeds.daily_series(spark, sf_dir)
    corrected = forecast.scale_correction(feeds.next_week(daily), forecast.recent_mean(daily))
    return corrected.select("series", "ds", "forecast", F.round("factor", 6).alias("factor"))


def _f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day forecast by the mean of the seven before it, judged per series."""
    daily = feeds.daily_series(spark, sf_dir)
    before = Window.partitionBy("series").orderBy("ds").rowsBetween(-7, -1)
    spent = F.sum(F.rint(F.col("y") * 100).cast("long")).over(before)
    guesses = daily.select(
        "series", "ds", F.round(spent / 100.0 / F.count("*").over(before), 2).alias("forecast")
    ).where(F.col("forecast").isNotNull())
    bounded = guesses.withColumns(
        {"lower_ci": F.col("forecast") - 500, "upper_ci": F.col("forecast") + 500}
    )
    return forecast.evaluate(bounded, daily)


def _f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.retrain(feeds.daily_series(spark, sf_dir), new_folder(spark, "retrained"))


def _f11_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted model on origins that it has not seen, beside the seven-day mean from the same ones."""
    daily = feeds.daily_series(spark, sf_dir)
    origins = forecast.scored_origins(daily)
    made = forecast.forecast(daily, feeds.forecaster(spark, sf_dir), origins)
    plain = forecast.mean_forecasts(daily, origins)

    def scored(rows: DataFrame) -> DataFrame:
        y = F.col("y")
        error = F.log1p(y) - F.log1p(F.greatest("forecast", F.lit(0.0)))
        inside = y.between(F.col("lower_ci"), F.col("upper_ci")).cast("int")
        return rows.join(daily.select("series", "ds", "y"), ["series", "ds"]).where(y > 0).agg(
            F.count("*").alias("num_days"), F.avg(forecast.huber(error)).alias("loss"), F.avg(inside).alias("inside")
        )

    model = scored(made).select("num_days", F.col("loss").alias("model_loss"), "inside")
    bounded = F.col("inside").between(0.8, 0.98)  # the bounds are those of 90 %
    mean = scored(plain).select(F.col("loss").alias("mean_loss"))
    return model.join(F.broadcast(mean)).select(
        "num_days", F.round("mean_loss", 4).alias("mean_loss"),
        (F.col("model_loss") <= 1.05 * F.col("mean_loss")).alias("model_keeps_up"), bounded.alias("bounds_hold"),
    )


def _a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the plain forecast; the arrays as text, which compares in any engine."""
    report = alerts.forecast_report(feeds.next_week(feeds.daily_series(spark, sf_dir)))

    def joined(name: str):
        return F.array_join(F.transform(name, lambda v: F.format_number(v, 2)), " ").alias(name)

    return report.select(
        "series", "type", "horizon", F.array_join("dates", " ").alias("dates"),
        joined("forecast"), joined("lower_ci"), joined("upper_ci"), "total_projected",
    )


def _t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts made as the feed runs, without any history: from two closed days on."""
    store = _new_store(spark)
    history = _total(spark, sf_dir).select("ds", "y", "units", "orders").limit(0)
    drain(
        forecast_on_day_start(
            _stream(spark, sf_dir), store, history, feeds.forecaster(spark, sf_dir), once=True
        )
    )
    found = live.forecast_vs_actual(store.forecasts().read(), feeds.day_counts(spark, sf_dir))
    ordered = (F.col("lower_ci") <= F.col("predicted")) & (F.col("predicted") <= F.col("upper_ci"))
    return found.select("day", "actual", ordered.alias("in_order"))


HISTORY_CUT_DAYS = 20


def _t8_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last days as a feed and all days before them as history, with the values of the forecasts."""
    store, folder = _new_store(spark), new_folder(spark, "feed")
    days = _total(spark, sf_dir).select("ds", "y", "units", "orders")
    cut = F.date_sub(F.lit(days.agg(F.max("ds")).first()[0]), HISTORY_CUT_DAYS)
    messages = spark.read.text(feeds.event_dir(spark, sf_dir))
    messages.where(F.to_date(F.get_json_object("value", "$.simulated_day")) >= cut).write.options(
        **feeds.COMPRESSED
    ).text(folder)
    drain(
        forecast_on_day_start(
            read_event_files(spark, folder), store, days.where(F.col("ds") < cut), feeds.forecaster(spark, sf_dir),
            once=True,
        )
    )
    found = live.forecast_vs_actual(store.forecasts().read(), feeds.day_counts(spark, sf_dir))
    ordered = (F.col("lower_ci") <= F.col("predicted")) & (F.col("predicted") <= F.col("upper_ci"))
    return found.select("day", "actual", "predicted", "lower_ci", "upper_ci", ordered.alias("in_order"))


def _r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.warehouse_documents(feeds.star(spark, sf_dir)).select(
        "type", "text", F.to_json("metadata").alias("metadata")
    )


def _r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, postings = text.load_index(spark, feeds.document_index(spark, sf_dir))
    return postings.select("doc_id", "term", F.round("weight", text.DECIMALS).alias("weight"))


def _r2_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, their weights' sum and the heaviest weight of each given document."""
    _, postings = text.load_index(spark, feeds.given_index(spark, sf_dir))
    return postings.groupBy("doc_id").agg(
        F.count("*").alias("num_terms"), F.round(F.sum("weight"), 5).alias("total_weight"),
        F.round(F.max("weight"), 5).alias("most_weight"),
    )


def _label_means(vectors: DataFrame) -> DataFrame:
    """(label, mean): the mean vector of each label."""
    return (
        vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"))
        .select("label", F.col("parts.x").alias("mean"))
    )


def _r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three vectors nearest to the mean vector of each label."""
    vectors = feeds.table(spark, sf_dir, "embeddings")
    return top_k_similar(
        _label_means(vectors), vectors, query_id="label", query_vector="mean", vector="embedding"
    ).withColumnRenamed("query_id", "label")


def _r3_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the three nearest vectors of each label's mean, and of each vector whose id is
    divisible by 100, the projections find."""
    vectors = feeds.table(spark, sf_dir, "embeddings")
    means = _label_means(vectors).select((-1 - F.col("label")).cast("long").alias("query_id"), F.col("mean").alias("vector"))
    asked = vectors.where(F.col("vec_id") % 100 == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    asked = means.unionByName(asked)
    exact = top_k_similar(asked, vectors, vector="embedding")
    return recall(top_k_by_projections(asked, vectors, vector="embedding"), exact).select(
        "neighbours", (F.col("found") >= 0.95 * F.col("neighbours")).alias("recall_0_95")
    )


def _r3_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three warehouse documents nearest to each conversation turn."""
    rarity, postings = text.load_index(spark, feeds.document_index(spark, sf_dir))
    turns = feeds.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = text.nearest_texts(turns, rarity, postings, ["conv_id", "turn"])
    texts = feeds.warehouse_texts(spark, sf_dir).select("doc_id", F.col("text").alias("source_text"))
    return found.join(texts, "doc_id")


def _r3_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three given documents nearest to each whose id is divisible by 100."""
    rarity, postings = text.load_index(spark, feeds.given_index(spark, sf_dir))
    asked = feeds.table(spark, sf_dir, "documents").where(F.col("doc_id") % 100 == 0)
    asked = asked.select(F.col("doc_id").alias("query_id"), "text")
    return text.nearest_texts(asked, rarity, postings, ["query_id"])


def _r4_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rarity, postings = text.load_index(spark, feeds.document_index(spark, sf_dir))
    return text.answer_questions(
        feeds.questions(spark, sf_dir), feeds.star(spark, sf_dir), feeds.warehouse_texts(spark, sf_dir), rarity, postings
    )


FORECAST: dict[str, Query] = {
    "f1_calendar_features": _f1,
    "f2_log_features": _f2,
    "f3_minmax": _f3,
    "f3_level_quantiles": lambda spark, d: series.level_quantiles(feeds.daily_series(spark, d)).withColumn(
        "level", F.round("level", 4)
    ),
    "f4_sliding_samples": _f4,
    "f5_chrono_split": _f5,
    "f6_fit_forecaster": _f6,
    "f7_forecast": _f7,
    "f7_horizon_totals": _f7_totals,
    "f8_scale_correction": _f8,
    "f9_forecast_kpis": lambda spark, d: forecast.forecast_kpis(
        feeds.next_week(feeds.daily_series(spark, d))
    ),
    "f10_series_lengths": lambda spark, d: forecast.series_lengths(feeds.daily_series(spark, d)),
    "f10_retrain": _f10,
    "f11_evaluate": _f11,
    "f11_evaluate_forecaster": _f11_model,
    "a3_forecast_report": _a3,
    "t8_forecast_on_day_start": _t8,
    "t8_forecast_with_history": _t8_history,
}

TEXT: dict[str, Query] = {
    "r1_warehouse_documents": _r1,
    "r2_index_documents": _r2,
    "r2_index_given_documents": _r2_given,
    "r3_top_k_similar": _r3,
    "r3_similar_lsh": _r3_lsh,
    "r3_top_k_documents": _r3_questions,
    "r3_top_k_given_documents": _r3_given,
    "r4_answer_questions": _r4_answers,
    "r4_route_questions": lambda spark, d: text.route_questions(feeds.questions(spark, d)),
}

QUERIES: dict[str, Query] = {**BATCH, **LIVE, **FORECAST, **TEXT}
