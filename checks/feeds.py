"""Inputs of the registered queries, derived once per session from the given tables.

The order tables are seen as retail transactions, written as raw CSV, ingested into the lake and
loaded into the warehouse with the library's own jobs. The stores lie in the shared folder of the
session and are filled once per (application, table folder).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.operators.events import enrich_events
from tillstream.operators.forecast import Forecaster, load_forecaster, retrain
from tillstream.operators.star import Star
from tillstream.operators.text import index_documents, warehouse_documents
from tillstream.plans import revenue
from tillstream.session import new_folder, scratch_freed
from tillstream.sources import lake, warehouse
from tillstream.sources.events import read_event_files
from tillstream.sources.live_store import LiveStore
from tillstream.sources.tables import folder_names, publish_folder
from tillstream.streaming.live import DAY_SCHEMA, close_days, drain, write_hot_events

# Text stores are four to nine times smaller so; readers tell it by the files' names.
COMPRESSED = {"compression": "gzip"}
# A quarter larger than the default level and written in half the time.
COMPRESSED_FAST = {**COMPRESSED, "zlib.compress.level": "BEST_SPEED"}

_stored: dict[tuple[str, str, str], str] = {}
_opened: dict[str, Star] = {}

RETAIL_VIEW = """
SELECT concat(CASE WHEN o.o_orderkey % 40 = 0 THEN 'C' ELSE '' END, CAST(o.o_orderkey AS {S})) AS invoice,
       lpad(CAST(l.l_partkey AS {S}), 5, '0') AS stock_code,
       CASE WHEN l.l_partkey % 50 = 0 AND l.l_linenumber = 7 THEN NULL
            ELSE concat(p.p_name, ' ', CAST(p.p_partkey AS {S})) END AS description,
       CASE WHEN o.o_orderkey % 53 = 0 THEN -l.l_quantity ELSE l.l_quantity END AS quantity,
       CASE WHEN l.l_partkey % 70 = 0 AND l.l_linenumber = 1 THEN 0
            ELSE floor(floor(l.l_extendedprice * 100 + 0.5) / (l.l_quantity * 1000)) / 100 END AS price,
       o.o_orderdate + {T} AS invoice_date,
       CASE WHEN o.o_custkey % 20 = 0 THEN NULL ELSE CAST(o.o_custkey AS {S}) END AS customer_id,
       n.n_name AS country
FROM lineitem l
JOIN orders o   ON l.l_orderkey = o.o_orderkey
JOIN part p     ON l.l_partkey = p.p_partkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n   ON c.c_nationkey = n.n_nationkey
"""

# The same joins in another order: orders meet their customers first, so that lines are dealt by order and by part
# only, and by order while they are short.
_RETAIL_FROM = RETAIL_VIEW[RETAIL_VIEW.index("FROM lineitem"):]
JOINS_BY_SIZE = """FROM lineitem l
JOIN (orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)
  ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, label: str, fill: Callable[[str], None]) -> str:
    """The folder of a derived store; ``fill`` writes it the first time it is asked for."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    known = (spark.sparkContext.applicationId, sf_dir, label)
    if known not in _stored:
        path = new_folder(spark, label)
        fill(path)
        _stored[known] = path
    return _stored[known]


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order tables in the shape of the raw file."""
    for name in ("lineitem", "orders", "part", "customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    seconds = "make_dt_interval(0, 0, 0, (o.o_orderkey * 7919) % 86400)"
    view = spark.sql(RETAIL_VIEW.replace(_RETAIL_FROM, JOINS_BY_SIZE).format(S="STRING", T=seconds))
    return view.select(
        F.col("invoice").alias("Invoice"),
        F.col("stock_code").alias("StockCode"),
        F.col("description").alias("Description"),
        F.col("quantity").cast("double").alias("Quantity"),
        F.col("invoice_date").alias("InvoiceDate"),
        F.col("price").cast("double").alias("Price"),
        F.col("customer_id").alias("Customer ID"),
        F.col("country").alias("Country"),
    )


def faulty_csv_dir(spark: SparkSession, sf_dir: str) -> str:
    """The raw sales as lines without a header; those to China whose customer number ends with 7 have a
    field too many, those to Japan ending with 3 have a quantity that is no number."""

    def fill(path: str) -> None:
        rows = raw_sales(spark, sf_dir)
        many = (F.col("Country") == "CHINA") & F.col("Customer ID").endswith("7")
        odd = (F.col("Country") == "JAPAN") & F.col("Customer ID").endswith("3")
        rows = rows.withColumn("Quantity", F.when(odd, "some").otherwise(F.col("Quantity").cast("string")))
        line = F.to_csv(F.struct(*rows.columns), {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "escape": '"'})
        rows.select(F.when(many, F.concat(line, F.lit(",surplus"))).otherwise(line).alias("value")).write.text(path)

    return once(spark, sf_dir, "faulty-csv", fill)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country to region; the Middle East is left out so that the default region occurs."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region").where(F.col("r_name") != "MIDDLE EAST")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("country"), F.col("r_name").alias("region")
    )


def csv_dir(spark: SparkSession, sf_dir: str) -> str:
    return once(
        spark, sf_dir, "raw-csv",
        lambda path: raw_sales(spark, sf_dir).write.option("header", True)
        .option("escape", '"').options(**COMPRESSED).csv(path),
    )


def lake_dir(spark: SparkSession, sf_dir: str) -> str:
    return once(
        spark, sf_dir, "lake", lambda path: lake.ingest(spark, csv_dir(spark, sf_dir), path)
    )


def sales(spark: SparkSession, sf_dir: str, with_row_id: bool = False) -> DataFrame:
    return lake.read_lake(spark, lake_dir(spark, sf_dir), with_row_id)


def star(spark: SparkSession, sf_dir: str) -> Star:
    """The warehouse, loaded and opened once per session."""
    path = once(
        spark, sf_dir, "warehouse",
        lambda path: warehouse.load_warehouse(
            sales(spark, sf_dir, with_row_id=True), regions(spark, sf_dir), path
        ),
    )
    if path not in _opened:
        _opened[path] = warehouse.open_warehouse(spark, path)
    return _opened[path]


EVENT_FILES = 8
# A compressed file is read by one task, so a large feed's files are cut into pieces of so many events.
PIECE_EVENTS = 1_000_000


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the live feed in day order, as many partitions as it has files."""
    rows = sales(spark, sf_dir, with_row_id=True)
    pieces = max(1, -(-rows.count() // (EVENT_FILES * PIECE_EVENTS)))
    return enrich_events(rows, EVENT_FILES * pieces)


def event_dir(spark: SparkSession, sf_dir: str) -> str:
    """The live feed as JSON lines, in day order over eight files, each cut into equally many pieces."""

    def fill(path: str) -> None:
        with scratch_freed(spark):
            feed_events(spark, sf_dir).write.options(**COMPRESSED).json(path)

    return once(spark, sf_dir, "events", fill)


def event_pieces(spark: SparkSession, sf_dir: str) -> int:
    """Pieces of each of the eight files."""
    names = folder_names(spark, event_dir(spark, sf_dir))
    return max(1, sum(name.startswith("part-") for name in names) // EVENT_FILES)


def live_store(spark: SparkSession, sf_dir: str) -> LiveStore:
    """A live store whose hot table has taken in the whole feed."""

    def fill(path: str) -> None:
        store = LiveStore(spark, path)
        events = read_event_files(spark, event_dir(spark, sf_dir))
        drain(write_hot_events(events, store.hot_path, store.checkpoint("hot"), once=True))

    return LiveStore(spark, once(spark, sf_dir, "live", fill))


def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_store(spark, sf_dir).hot()


def write_late_batches(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The three batches of ``late_store`` as folders ``part=0`` to ``part=2``: messages as in ``event_dir``, written in
    one pass. A message can be in two batches, and a batch without any has no folder."""
    with scratch_freed(spark):
        made = feed_events(spark, sf_dir)
        newest = sales(spark, sf_dir).select(F.to_date("InvoiceDate")).distinct().count() - 1  # days count from 0
        day, place = F.col("day_index"), F.col("row_in_day")
        late = (day == 5) | ((day == 3) & (place == 0))
        last = day > newest - 20
        parts = [~late & ~last, ~late & last, late | (day == 0)]
        found = F.filter(F.array(*[F.when(part, number) for number, part in enumerate(parts)]), lambda n: n.isNotNull())
        # The events have a session of their own; a task writes all three files at a time, without a sort by batch.
        made.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", len(parts))
        made.withColumn("part", F.explode(found)).write.partitionBy("part").options(**COMPRESSED_FAST).json(path)


def late_store(spark: SparkSession, sf_dir: str) -> LiveStore:
    """A live store with closed days and a hot table without repeats.

    The feed comes in three batches: the days but the last twenty, these, and what is late: the
    first sale of the fourth day, the whole sixth day, and once more the first day. The closed days are
    stored as the stream closed them, without what is late; the hot table has all of it once.
    """

    def fill(path: str) -> None:
        store, folder = LiveStore(spark, path), f"{path}/feed"
        write_late_batches(spark, sf_dir, f"{path}/batches")
        for number in range(3):
            if folder_names(spark, batch := f"{path}/batches/part={number}"):
                publish_folder(spark, batch, f"{folder}/{number}")
            events = read_event_files(spark, f"{folder}/*")
            # Neither job reads what the other writes, so they share the cluster.
            jobs = [
                close_days(events, store.closed_path, store.checkpoint("close"), once=True),
                write_hot_events(events, store.hot_path, store.checkpoint("hot"), once=True, distinct=True),
            ]
            for job in jobs:
                drain(job)

    return LiveStore(spark, once(spark, sf_dir, "late", fill))


def closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DAY_SCHEMA).parquet(late_store(spark, sf_dir).closed_path)


def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_store(spark, sf_dir).hot_table().day_counts()


def simple_forecasts(days: DataFrame) -> DataFrame:
    """Forecasts that SQL can state too: the mean of the last seven days, for the day after.

    ``days`` has ds and y. Stands in for the model where only the use of forecasts is checked.
    """
    last_week = Window.orderBy("ds").rowsBetween(-6, 0)
    spent = F.sum(F.rint(F.col("y") * 100).cast("long")).over(last_week)
    mean = F.round(spent / 100.0 / F.count("*").over(last_week), 2)
    return days.select(
        F.date_add("ds", 1).alias("simulated_day"),
        mean.alias("predicted_revenue"),
        F.round(mean - 250, 2).alias("lower_ci"),
        F.round(mean + 250, 2).alias("upper_ci"),
        F.lit(None).cast("timestamp").alias("generated_at"),
    )


def simple_outlook(forecasts: DataFrame) -> DataFrame:
    """Seven days from each forecast on, half a percent more per day."""
    step = F.col("step")
    return forecasts.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("step")).select(
        F.col("simulated_day").alias("generated_day"),
        F.date_add("simulated_day", step).alias("forecast_date"),
        *[
            F.round(F.col(name) * (1 + step / 200), 2).alias(name)
            for name in ("predicted_revenue", "lower_ci", "upper_ci")
        ],
    )


def forecasts(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """Forecasts from the days that a hot table counted, by default that of ``live_store``."""
    days = day_counts(spark, sf_dir) if counts is None else counts
    return simple_forecasts(days.select(F.col("simulated_day").alias("ds"), F.col("actual_revenue").alias("y")))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series of all sales and of each country, stored once."""

    def fill(path: str) -> None:
        warehouse_star = star(spark, sf_dir)
        total = revenue.daily_totals(warehouse_star).select(
            F.lit("total").alias("series"), "ds", "y", "units", "orders"
        )
        revenue.daily_series_by_country(warehouse_star).unionByName(total).write.parquet(path)

    return spark.read.parquet(once(spark, sf_dir, "daily-series", fill))


def forecaster(spark: SparkSession, sf_dir: str) -> Forecaster:
    path = once(
        spark, sf_dir, "forecaster",
        lambda path: retrain(daily_series(spark, sf_dir), path),
    )
    return load_forecaster(spark, path)


def next_week(days: DataFrame) -> DataFrame:
    """A plain seven-day forecast per series, which SQL can state too: the last day's revenue,
    a fifth more for each day ahead."""
    last = days.groupBy("series").agg(F.max("ds").alias("origin"), F.max_by("y", "ds").alias("y"))
    step = F.col("step")
    value = F.col("y") * (1 + step / 5)
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(7)))).select(
        "series", "origin", F.date_add("origin", step).alias("ds"),
        F.round(value, 2).alias("forecast"),
        F.round(value - 100, 2).alias("lower_ci"),
        F.round(value + 100, 2).alias("upper_ci"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn, and questions made from every part, nation and segment name."""
    turns = table(spark, sf_dir, "conversations").select(F.col("text").alias("question"))
    part = table(spark, sf_dir, "part").select(
        F.format_string("What are the TOP %d products like %s ?", F.col("p_size"), "p_name")
        .alias("question")
    )
    nation = table(spark, sf_dir, "nation").select(
        F.explode(
            F.array(
                F.format_string("Monthly sales in %s", "n_name"),
                F.format_string("Compare %s with other countries", "n_name"),
                F.format_string("Which item sold best in %s", "n_name"),
                F.format_string("Tell me about %s", "n_name"),
            )
        ).alias("question")
    )
    segment = table(spark, sf_dir, "customer").select(
        F.format_string("Which customer type is %s", F.col("c_mktsegment")).alias("question")
    ).distinct()
    return turns.unionByName(part).unionByName(nation).unionByName(segment)


def warehouse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warehouse documents with the rank of their text as id; there are a few hundred."""

    def fill(path: str) -> None:
        place = F.row_number().over(Window.orderBy("text", "type"))
        warehouse_documents(star(spark, sf_dir)).withColumn("doc_id", place.cast("long")).write.parquet(path)

    return spark.read.parquet(once(spark, sf_dir, "warehouse-texts", fill))


def document_index(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the index over the warehouse documents."""
    return once(
        spark, sf_dir, "document-index", lambda path: index_documents(warehouse_texts(spark, sf_dir), path)
    )


def given_index(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the index over the given documents."""
    return once(
        spark, sf_dir, "given-index", lambda path: index_documents(table(spark, sf_dir, "documents"), path)
    )
