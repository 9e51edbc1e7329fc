"""Live events in, hot table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream import schemas
from tillstream.functions.columns import customer_or_guest


def message_counts(messages: DataFrame) -> DataFrame:
    """One row: messages, events, and the messages that ``parse_events`` drops, by what they lack;
    ``no_time`` counts events that are kept without a time."""
    event = F.from_json(F.col("value").cast("string"), schemas.LIVE_EVENT)
    parsed = messages.select(F.col("value").cast("string").alias("value"), event.alias("e"))
    # A message that is no JSON object gives an event whose fields are all null.
    is_json = F.coalesce(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"), F.lit(False))
    day = F.to_date("e.simulated_day")
    return parsed.agg(
        F.count("*").alias("messages"),
        F.count_if(day.isNotNull()).alias("events"),
        F.count_if(~is_json).alias("no_json"),
        F.count_if(is_json & day.isNull()).alias("no_day"),
        F.count_if(day.isNotNull() & F.try_to_timestamp("e.invoice_date").isNull()).alias("no_time"),
    )


def parse_events(messages: DataFrame) -> DataFrame:
    """JSON messages (column ``value``) to typed events; a message that is no JSON or has no day is
    dropped, and ``message_counts`` tells how many.

    The event time is a ``timestamp``, as a watermark needs, read in the session's time zone.
    """
    event = F.from_json(F.col("value").cast("string"), schemas.LIVE_EVENT)
    return (
        # A generator, which no condition passes: a condition on a field would parse every message once more.
        messages.select(F.inline(F.array(event)))
        .where(F.col("simulated_day").isNotNull())
        .withColumns(
            {
                "customer_id": customer_or_guest(F.col("customer_id")),
                "invoice_date": F.try_to_timestamp("invoice_date"),
                "simulated_day": F.to_date("simulated_day"),
            }
        )
    )


def read_event_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of events from a folder of JSON lines."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_events(reader.load(path))


def read_event_topic(
    spark: SparkSession, servers: str, topic: str, rows_per_batch: int | None = None
) -> DataFrame:
    """Stream of events from a Kafka topic, from its earliest message on.

    Needs the Kafka connector package on the session's class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if rows_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", rows_per_batch)
    return parse_events(reader.load())


def hot_events(events: DataFrame) -> DataFrame:
    """The columns of the hot table, with the arrival time."""
    return events.select(
        "invoice", "stock_code", "description", "quantity", "price", "revenue", "customer_id",
        "country", "invoice_date", "simulated_day", "row_in_day",
        F.current_timestamp().alias("ingested_at"),
        (F.year("simulated_day") * 100 + F.month("simulated_day")).alias("sale_month"),
    )


def distinct_events(hot: DataFrame) -> DataFrame:
    """One row per event where the feed sent events twice; day and place name an event."""
    return hot.dropDuplicates(["simulated_day", "row_in_day"])
