"""Live jobs: hot table, running figures, recent sales and day close.

Every job takes a stream of parsed events, a target and a checkpoint folder, and returns the
running query. ``once=True`` works off what is there and stops; otherwise batches start at the
given interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tillstream.functions.columns import cents
from tillstream.sources.events import hot_events
from tillstream.sources.hot import HotTable
from tillstream.sources.tables import KeyedTable, stream_run

# Time between batches: each writes files to every month it touches, so batches are not too small.
BATCH_INTERVAL = "1 minute"
# Fixed value: length of the recent list.
RECENT_ROWS = 50

KPI_SCHEMA = (
    "total_live_revenue double, total_txns long, total_units long, avg_txn_value double, "
    "unique_customers long, countries long"
)
RECENT_SCHEMA = (
    "invoice string, stock_code string, description string, revenue double, country string, "
    "invoice_date timestamp, simulated_day date, row_in_day long, batch_no long"
)
PROGRESS_SCHEMA = "current_day date, total_rows long"
DAY_SCHEMA = "simulated_day date, actual_revenue double, units long, num_events long, orders long"


def start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=BATCH_INTERVAL)
    return writer.start()


def drain(query: StreamingQuery) -> None:
    """Wait for a ``once`` query; raises what made it fail."""
    query.awaitTermination()


def write_hot_events(
    events: DataFrame, path: str, checkpoint: str, once: bool = False, distinct: bool = False
) -> StreamingQuery:
    """Append every event, late ones and those without a time too, to the hot table at ``path``.

    With ``distinct`` an event that the table has already is left out, however much later it comes again.
    Events arrive about in time order, so row groups within a month cover few days each and a day
    filter skips the others.
    """
    table = HotTable(events.sparkSession, path)

    def store(rows: DataFrame, batch: int) -> None:
        table.append(hot_events(rows), stream_run(rows.sparkSession, checkpoint), batch, distinct)

    return start(events.writeStream.foreachBatch(store), checkpoint, once)


def country_figures(events: DataFrame) -> DataFrame:
    """Additive figures per country, with a mergeable sketch of the customers."""
    return events.groupBy("country").agg(
        F.sum(cents(F.col("revenue"))).alias("earned"),
        F.count("*").alias("txns"),
        F.sum(F.col("quantity").cast("long")).alias("units"),
        F.hll_sketch_agg("customer_id", F.lit(14)).alias("customers"),
    )


def kpis_of(figures: DataFrame) -> DataFrame:
    """One row from the figures per country; the unique customers are an estimate."""
    txns = F.coalesce(F.sum("txns"), F.lit(0))
    earned = F.coalesce(F.sum("earned"), F.lit(0)) / 100.0
    return figures.agg(
        earned.alias("total_live_revenue"),
        txns.alias("total_txns"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("total_units"),
        F.round(earned / F.greatest(txns, F.lit(1)), 2).alias("avg_txn_value"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("customers")), F.lit(0)).alias(
            "unique_customers"
        ),
        F.count("country").alias("countries"),
    )


def running_kpis(events: DataFrame, table: KeyedTable, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the totals since the start. The state has one row per country; a repeated batch
    finds the same state and replaces the row by the same one."""

    def store(figures: DataFrame, batch: int) -> None:
        table.tidy(batch)
        table.write(kpis_of(figures), stream_run(figures.sparkSession, checkpoint), batch)

    writer = country_figures(events).writeStream.outputMode("complete").foreachBatch(store)
    return start(writer, checkpoint, once)


def day_progress(events: DataFrame, table: KeyedTable, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Current day and rows so far."""
    totals = events.groupBy().agg(
        F.max("simulated_day").alias("current_day"), F.count("*").alias("total_rows")
    )

    def store(row: DataFrame, batch: int) -> None:
        table.tidy(batch)
        table.write(row, stream_run(row.sparkSession, checkpoint), batch)

    return start(totals.writeStream.outputMode("complete").foreachBatch(store), checkpoint, once)


def newest(events: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """The last to arrive, and within a batch the last by day and place in the day."""
    columns = [c.split()[0] for c in RECENT_SCHEMA.split(", ")]
    return (
        events.select(*columns)
        .orderBy(F.desc("batch_no"), F.desc("simulated_day"), F.desc("row_in_day"))
        .limit(n)
    )


def recent_ring(
    events: DataFrame, table: KeyedTable, checkpoint: str, n: int = RECENT_ROWS, once: bool = False
) -> StreamingQuery:
    """Keep the newest ``n`` sales: the n of the batch and the n kept before it compete."""

    def store(rows: DataFrame, batch: int) -> None:
        table.tidy(batch)
        run = stream_run(rows.sparkSession, checkpoint)
        arrived = newest(rows.withColumn("batch_no", F.lit(batch).cast("long")), n)
        table.write(newest(arrived.unionByName(table.read(before=(run, batch))), n), run, batch)

    return start(events.writeStream.foreachBatch(store), checkpoint, once)


def window_counts(rows: DataFrame, time: str, every: str = "1 second") -> DataFrame:
    """Rows per time window."""
    return rows.groupBy(F.window(time, every).alias("w")).agg(F.count("*").alias("num_rows")).select(
        F.col("w.start").alias("window_start"), "num_rows"
    )


def throughput(
    rows: DataFrame, time: str, path: str, checkpoint: str, every: str = "1 second",
    delay: str = "10 seconds", once: bool = False,
) -> StreamingQuery:
    """Append each window once the watermark has passed it."""
    counts = window_counts(rows.withWatermark(time, delay), time, every)
    return start(counts.writeStream.format("parquet").option("path", path), checkpoint, once)


def _in_utc(events: DataFrame) -> None:
    """Windows of a day are cut at midnight UTC, dates in the session's zone: both must agree."""
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"days are closed in UTC; the session's time zone is {zone}")


def closing_days(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of day totals, each emitted when the watermark leaves the day.

    The first aggregation keeps a row per invoice of the open days, the second counts these rows, so
    ``orders`` is exact. An event whose time does not parse counts at the start of its day. One that
    comes after its day closed changes no total here, nor in the file of ``close_days``:
    ``forecast_on_day_start`` and ``correct_days`` bring it into the stored days, ``current_days`` of
    the plans into what is read.
    """
    _in_utc(events)
    at = F.coalesce("invoice_date", F.col("simulated_day").cast("timestamp"))
    invoices = (
        events.withColumn("event_time", at).withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day").alias("w"), "invoice")
        .agg(
            F.sum(cents(F.col("revenue"))).alias("earned"),
            F.sum(F.col("quantity").cast("long")).alias("units"),
            F.count("*").alias("num_events"),
        )
    )
    return invoices.groupBy(F.window("w", "1 day").alias("w")).agg(
        (F.sum("earned") / 100.0).alias("actual_revenue"),
        F.sum("units").alias("units"),
        F.sum("num_events").alias("num_events"),
        F.count("*").alias("orders"),
    ).select(F.to_date("w.start").alias("simulated_day"), "actual_revenue", "units", "num_events", "orders")


def close_days(
    events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", once: bool = False
) -> StreamingQuery:
    writer = closing_days(events, delay).writeStream.format("parquet").option("path", path)
    return start(writer, checkpoint, once)


def day_totals(hot: DataFrame) -> DataFrame:
    """The totals of all days in the hot table."""
    return hot.groupBy("simulated_day").agg(
        (F.sum(cents(F.col("revenue"))) / 100.0).alias("actual_revenue"),
        F.sum(F.col("quantity").cast("long")).alias("units"),
        F.count("*").alias("num_events"),
        F.count_distinct("invoice").alias("orders"),
    )


def miscounted_days(closed: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``counts`` for days that ``closed`` lacks, or of which it counted another number of
    events. A day stored without a count stays as it is."""
    stored = closed.select(
        "simulated_day", F.col("num_events").alias("stored_events"), F.lit(True).alias("is_stored")
    )
    differs = F.col("is_stored").isNull() | (F.col("num_events") != F.col("stored_events"))
    return counts.join(F.broadcast(stored), "simulated_day", "left").where(differs).select(counts.columns)


def corrected_days(closed: DataFrame, table: HotTable) -> DataFrame | None:
    """The days up to the newest closed one whose stored totals miss late events, and those whose
    events all came late, with the totals of the hot table; None where there is no such day.

    The table's counters tell which days these are. Only their events are read, for the distinct invoices.
    """
    newest = closed.agg(F.max("simulated_day")).scalar()
    wrong = miscounted_days(closed, table.day_counts().where(F.col("simulated_day") <= newest)).select(
        "sale_month", "simulated_day"
    ).collect()  # a row per day
    if not wrong:
        return None
    months = sorted({r["sale_month"] for r in wrong})
    days = table.spark.createDataFrame(wrong, "sale_month int, simulated_day date")
    return day_totals(
        table.read().where(F.col("sale_month").isin(months)).join(
            F.broadcast(days), ["sale_month", "simulated_day"], "left_semi"
        )
    )


def correct_days(table: KeyedTable, hot: HotTable) -> None:
    """Bring late events, and days that came late as a whole, into the stored totals of closed days."""
    found = corrected_days(table.read(), hot)
    if found is not None:
        table.write(found)


def with_open(closed: DataFrame, all_windows: DataFrame, end: Column, newest_time: Column, delay: str) -> DataFrame:
    """The windows that the stream closed, and of ``all_windows`` those that it had to leave open.

    A window is open if its ``end`` lies behind the watermark, the newest event time less ``delay``.
    A window that should have closed is taken from the stream alone: if it is missing there, it is
    missing here. ``closed_by_stream`` tells them apart.
    """
    still_open = all_windows.where(end > newest_time - F.expr(f"INTERVAL {delay}"))
    return closed.withColumn("closed_by_stream", F.lit(True)).unionByName(
        still_open.withColumn("closed_by_stream", F.lit(False))
    )


def batch_sizes(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Log the rows of each micro-batch; a repeated batch overwrites its own record."""

    def store(rows: DataFrame, batch: int) -> None:
        rows.agg(F.lit(batch).cast("long").alias("batch"), F.count("*").alias("num_rows")).write.mode(
            "overwrite"
        ).parquet(f"{path}/batch_{batch}")

    return start(events.writeStream.foreachBatch(store), checkpoint, once)
