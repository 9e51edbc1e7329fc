from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from checks import feeds
from tests.helpers import at, lake_of, sale, values
from tillstream import schemas
from tillstream.operators.events import enrich_events
from tillstream.plans import live
from tillstream.session import new_folder
from tillstream.sources.events import hot_events, parse_events
from tillstream.sources.hot import HotTable
from tillstream.sources.live_store import LiveStore
from tillstream.sources.tables import KeyedTable, delete_folder, folder_names


def hot(spark, rows):
    """``rows`` are (day, revenue) or (day, revenue, customer, country, code)."""
    made = []
    for place, row in enumerate(rows):
        day, revenue, customer, country, code = (*row, "c", "France", "A")[: 5] if len(row) == 2 else row
        at = datetime.fromisoformat(f"{day} 08:00:00")
        made.append((str(place), code, "thing", 1.0, revenue, revenue, customer, country, at,
                     at.date(), place, at, int(day[:4]) * 100 + int(day[5:7])))
    return spark.createDataFrame(made, schemas.HOT_EVENT)


def forecasts(spark, rows):
    made = [(date.fromisoformat(day), value, value - 1, value + 1, None) for day, value in rows]
    return spark.createDataFrame(made, schemas.FORECAST)


def test_events_number_days_and_places(spark):
    rows = [
        sale("2", when="2020-01-01 09:00:00", description="x" * 200),
        sale("1", when="2020-01-01 08:00:00"),
        sale("3", when="2020-01-03 08:00:00", customer=None),
    ] + [sale("4", when="2020-01-03 09:00:00")] * 3
    got = enrich_events(lake_of(spark, rows)).orderBy("simulated_day", "row_in_day")
    assert values(got, "invoice", "day_index", "row_in_day", "total_in_day", "is_day_start", "is_day_end") == [
        ("1", 0, 0, 2, True, False), ("2", 0, 1, 2, False, True), ("3", 1, 0, 4, True, False),
        ("4", 1, 1, 4, False, False), ("4", 1, 2, 4, False, False), ("4", 1, 3, 4, False, True),
    ]
    assert got.agg(F.max(F.length("description"))).first()[0] > 120  # cut where it is shown


def test_forecast_without_actual(spark):
    got = live.forecast_vs_actual(
        forecasts(spark, [("2020-01-01", 110.0), ("2020-01-02", 50.0)]),
        live.day_revenue(hot(spark, [("2020-01-01", 100.0)])),
    )
    assert values(got, "day", "predicted", "actual", "ape_pct") == [
        ("2020-01-01", 110.0, 100.0, 10.0), ("2020-01-02", 50.0, 0.0, None),
    ]


def test_closed_days_count_as_stored_and_others_from_the_counters(spark):
    counts = spark.createDataFrame(
        [(202001, date(2020, 1, 1), 1, 100.0, 1), (202001, date(2020, 1, 2), 2, 11.0, 2)],
        "sale_month int, simulated_day date, num_events long, actual_revenue double, units long",
    )
    closed = spark.createDataFrame([(date(2020, 1, 1), 99.0)], "simulated_day date, actual_revenue double")
    got = sorted(values(live.current_days(closed, counts), "simulated_day", "actual_revenue"))
    assert got == [(date(2020, 1, 1), 99.0), (date(2020, 1, 2), 11.0)]
    counted = closed.withColumn("num_events", F.lit(3).cast("long"))
    got = sorted(values(live.current_days(counted, counts), "simulated_day", "actual_revenue"))
    assert got == [(date(2020, 1, 1), 100.0), (date(2020, 1, 2), 11.0)]
    assert live.current_days(closed.limit(0), counts).count() == 2


def test_live_day_replaces_history(spark):
    days = [("2020-01-01", 1.0), ("2020-01-02", 2.0)]
    columns = "ds date, y double"
    history = spark.createDataFrame([(date.fromisoformat(d), y) for d, y in days], columns)
    fresh = spark.createDataFrame([(date(2020, 1, 2), 9.0), (date(2020, 1, 3), 3.0)], columns)
    merged = live.merge_history(history, fresh, F.lit("2020-01-03").cast("date"))
    assert sorted(values(merged, "y")) == [(1.0,), (9.0,)]
    assert live.can_forecast(merged).count() == 2
    assert live.can_forecast(merged.limit(1)).count() == 0


def test_running_mean_error(spark):
    made = forecasts(spark, [("2020-01-01", 110.0), ("2020-01-02", 50.0), ("2020-01-04", 1.0)])
    sold = live.day_revenue(hot(spark, [("2020-01-01", 100.0), ("2020-01-02", 100.0), ("2020-01-03", 5.0)]))
    got = live.accuracy_report(made, sold).orderBy("simulated_day")
    assert values(got, "ape_pct", "mape", "days_streamed") == [(10.0, 10.0, 1), (50.0, 30.0, 2)]
    score = live.mean_error(made, sold)
    assert values(score, "mape", "days_streamed", "grade") == [(30.0, 2, "FAIR")]
    counters = hot(spark, [("2020-01-01", 1.0), ("2020-01-05", 1.0)]).withColumn("num_events", F.lit(1))
    status = live.stream_status(counters, score).first()
    assert (str(status["current_day"]), status["total_rows"], status["mape"]) == ("2020-01-05", 2, 30.0)


@pytest.mark.parametrize("mape, grade", [(None, None), (19.99, "GOOD"), (20.0, "FAIR"), (40.0, "POOR")])
def test_grades(spark, mape, grade):
    row = spark.createDataFrame([(mape,)], "m double")
    assert row.select(live.accuracy_grade(F.col("m"))).first()[0] == grade


def test_top_lists(spark):
    events = hot(spark, [
        ("2020-01-01", 10.0, "a", "Spain", "A"), ("2020-01-01", 5.0, "a", "Spain", "B"),
        ("2020-01-01", 5.0, "b", "Italy", "B"), ("2020-01-01", 2.5, "b", "Italy", "C"),
    ])
    assert values(live.top_product_share(events), "stock_code", "share_of_top_pct") == [
        ("A", 100.0), ("B", 100.0), ("C", 25.0),
    ]
    assert values(live.live_geo_revenue(events, 1), "country", "total_revenue", "unique_customers") == [
        ("Spain", 15.0, 1)
    ]
    arrivals = events.groupBy("ingested_at").agg(F.count("*").alias("num_events"))
    assert values(live.recent_transactions(events, arrivals, 2), "stock_code") == [("C",), ("B",)]


def test_writes_replace_by_key_and_repeat_safely(spark):
    table = KeyedTable(spark, new_folder(spark, "t"), "k int, v string", ["k"], ["v"])
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k int, v string")
    assert table.read().count() == 0
    table.write(rows((1, "a"), (2, "b"), (2, "a")), "job", 0)
    assert sorted(values(table.read(), "k", "v")) == [(1, "a"), (2, "b")]
    table.write(rows((2, "c"), (3, "d")), "job", 1)
    table.write(rows((2, "c"), (3, "d")), "job", 1)  # the same batch again
    assert sorted(values(table.read(), "k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(values(table.read(before=("job", 1)), "k", "v")) == [(1, "a"), (2, "b")]
    table.write(rows((1, "z")), "new checkpoint", 0)  # its batches count anew
    assert sorted(values(table.read(), "k", "v")) == [(1, "z"), (2, "c"), (3, "d")]
    table.compact()
    assert len(folder_names(spark, table.path)) == 1
    assert sorted(values(table.read(), "k", "v")) == [(1, "z"), (2, "c"), (3, "d")]
    assert sorted(values(table.read(before=("new checkpoint", 0)), "k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    table.write(rows((1, "z"), (4, "e")), "new checkpoint", 0)  # a batch that comes again after a compaction
    assert sorted(values(table.read(), "k", "v")) == [(1, "z"), (2, "c"), (3, "d"), (4, "e")]
    table.purge()
    assert table.read().count() == 0


def test_what_a_failed_write_or_compaction_left_is_not_read(spark):
    table = KeyedTable(spark, new_folder(spark, "t"), "k int, v string", ["k"])
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k int, v string")
    table.write(rows((1, "a")), "job", 0)
    rows((1, "broken")).write.parquet(f"{table.path}/write-000000000002")
    delete_folder(spark, f"{table.path}/write-000000000002/_SUCCESS")
    assert values(table.read(), "k", "v") == [(1, "a")]
    table.write(rows((1, "b"), (2, "b")), "job", 1)  # numbered behind the broken one
    before = [f"{table.path}/{name}" for name in folder_names(spark, table.path)]
    copies = {path: spark.read.parquet(path).collect() for path in before if not path.endswith("2")}
    table.compact()
    for path, kept in copies.items():  # as if it had stopped before it deleted them
        spark.createDataFrame(kept, "k int, v string, marker boolean, written long, run string, batch long").write.mode("overwrite").parquet(path)
    assert sorted(values(table.read(), "k", "v")) == [(1, "b"), (2, "b")]


def test_a_ring_batch_that_comes_again_after_a_compaction(spark):
    table = KeyedTable(spark, new_folder(spark, "t"), "v int")
    rows = lambda *found: spark.createDataFrame([(v,) for v in found], "v int")
    for batch, found in enumerate([(1,), (1, 2), (1, 2, 3)]):
        table.write(rows(*found), "job", batch)
    table.compact()
    again = table.read(before=("job", 2))
    assert sorted(values(again, "v")) == [(1,), (2,)]
    table.write(again.unionByName(rows(3)), "job", 2)
    assert sorted(values(table.read(), "v")) == [(1,), (2,), (3,)]


def test_a_table_without_keys_holds_its_newest_write(spark):
    table = KeyedTable(spark, new_folder(spark, "t"), "v string")
    for batch, found in enumerate([["a", "b"], ["c"], []]):
        table.write(spark.createDataFrame([(v,) for v in found], "v string"), "job", batch)
        assert sorted(r["v"] for r in table.read().collect()) == found


def test_reset_starts_an_empty_generation(spark):
    store = LiveStore(spark, new_folder(spark, "live"))
    store.forecasts().write(forecasts(spark, [("2020-01-01", 1.0)]))
    before = store.checkpoint("hot")
    store.reset()
    assert store.hot().count() == 0 and store.forecasts().read().count() == 0
    assert store.checkpoint("hot") != before and store.generation == 1 and store.files() == 0


def test_a_batch_with_repeats_keeps_each_event_once_and_others_as_they_are(spark):
    """Places met before are left out, those repeated in the batch stay once, and a batch without either is not joined."""
    table = HotTable(spark, new_folder(spark, "hot-repeats"))
    def batch(places):
        rows = [("1", "A", "tea", 1.0, 2.0, 2.0, "7", "France", at("2020-01-01 10:00:00"), at("2020-01-01").date(), p,
                 at("2020-01-02 00:00:00"), 202001) for p in places]
        return spark.createDataFrame(rows, schemas.HOT_EVENT)
    first = batch([0, 1, None, None])
    places = first.where("row_in_day is not null").select("sale_month", "simulated_day", "row_in_day")
    assert table._unseen(first, table._met(places, "r", 0)) is first
    for number, sent in enumerate(([0, 1, None, None], [1, 2, 2, 3, None], [2, 0])):
        table.append(batch(sent), "r", number, distinct=True)
    assert sorted(r[0] for r in values(table.read().where("row_in_day is not null"), "row_in_day")) == [0, 1, 2, 3]
    assert table.read().where("row_in_day is null").count() == 3


def test_text_feeds_are_compressed(spark):
    assert all(name.endswith(".gz") for f in (feeds.csv_dir, feeds.event_dir) for name in folder_names(
        spark, f(spark, "/root/testdata/sf0.001")) if name.startswith("part-"))
    assert feeds.event_pieces(spark, "/root/testdata/sf0.001") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_in_so_many_partitions_are_not_dealt_again(spark):
    rows = lake_of(spark, [sale(str(i), when=f"2020-01-{1 + i // 9:02} 10:{i % 9:02}:00") for i in range(40)])
    got = enrich_events(rows, 5)
    assert got.exceptAll(enrich_events(rows)).isEmpty() and got.count() == 40
    spans = got.groupBy(F.spark_partition_id().alias("task")).agg(
        F.min(F.struct("day_index", "row_in_day")).alias("first"), F.max(F.struct("day_index", "row_in_day")).alias("last")
    ).collect()
    spans = sorted((tuple(r["first"]), tuple(r["last"])) for r in spans)
    assert 3 <= len(spans) <= 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert "rangepartitioning" not in plan_of(got) and "Exchange hashpartitioning(invoice" not in plan_of(got)


def test_a_message_is_parsed_once(spark):
    messages = spark.createDataFrame(
        [(text,) for text in ('{"invoice":"1","simulated_day":"2020-01-01","row_in_day":0}', '{"invoice":"2"}', "no event",
                              '{"invoice":"3","simulated_day":"2020-01-01","quantity":"many"}', None)], "value string")
    events = parse_events(messages)
    assert sorted(values(events, "invoice", "row_in_day")) == [("1", 0), ("3", None)]
    folder = new_folder(spark, "messages")
    messages.where("value is not null").write.text(folder)
    assert plan_of(hot_events(parse_events(spark.read.text(folder)))).count("Generate inline(array(from_json(") == 1
    assert "Filter (isnotnull(value" not in plan_of(parse_events(spark.read.text(folder)))


def test_raw_sales_are_those_of_the_stated_joins(spark):
    """Repeated and missing keys too; lines are dealt by order and by part, not by customer."""
    made = {
        "lineitem": ("l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double",
                     [(1, 7, 1, 2.0, 90.0), (1, 8, 2, 3.0, 50.0), (2, 7, 1, 1.0, 10.0), (3, None, 1, 1.0, 1.0), (None, 7, 1, 1.0, 1.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
                   [(1, 4, at("2020-01-01 00:00:00")), (1, 5, at("2020-01-02 00:00:00")), (2, None, at("2020-01-03 00:00:00")),
                    (3, 4, at("2020-01-04 00:00:00"))]),
        "part": ("p_partkey long, p_name string", [(7, "tea"), (7, "cup"), (8, "lamp"), (None, "x")]),
        "customer": ("c_custkey long, c_nationkey long", [(4, 1), (5, 2), (5, 1), (None, 1)]),
        "nation": ("n_nationkey long, n_name string", [(1, "SPAIN"), (2, "ITALY")]),
    }
    folder = new_folder(spark, "tables")
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = feeds.raw_sales(spark, folder)
        by_customer = plan_of(got).split("Exchange hashpartitioning(o_custkey")
        assert len(by_customer) == 2 and "l_" not in by_customer[1].split("SortMergeJoin")[0]
        seconds = "make_dt_interval(0, 0, 0, (o.o_orderkey * 7919) % 86400)"
        want = spark.sql(feeds.RETAIL_VIEW.format(S="STRING", T=seconds)).select(
            "invoice", "stock_code", "description", F.col("quantity").cast("double"), "invoice_date",
            F.col("price").cast("double"), "customer_id", "country")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.toDF(*got.columns).collect()))
        assert got.count() == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_a_batch_without_repeats_is_read_once(spark):
    """The batch is parsed once, for its places and its events."""
    table, seen = HotTable(spark, new_folder(spark, "hot-once")), spark.sparkContext.accumulator(0)

    def place(p):
        seen.add(1)
        return p

    rows = [("1", "A", "tea", 1.0, 2.0, 2.0, "7", "France", at("2020-01-01 10:00:00"), at("2020-01-01").date(), p,
             at("2020-01-02 00:00:00"), 202001) for p in range(6)]
    sent = spark.createDataFrame(rows, schemas.HOT_EVENT).withColumn("row_in_day", F.udf(place, "long")("row_in_day"))
    table.append(sent, "r", 0, distinct=True)
    assert seen.value == 6 and table.read().count() == 6 and table.counters().first()["num_events"] == 6
    table.append(sent, "r", 1, distinct=True)
    assert seen.value == 12 and table.read().count() == 6
    assert not [n for n in folder_names(spark, f"{table.path}/arriving/run=r") if n.startswith("batch=")]


def test_late_batches_are_the_feeds_messages(spark):
    """The three batches hold the feed's lines as a filter over it finds them, and nothing else is built for them."""
    tables = "/root/testdata/sf0.001/."
    store = feeds.late_store(spark, tables)
    assert {label for _, folder, label in feeds._stored if folder == tables} == {"raw-csv", "lake", "late"}
    messages = spark.read.text(feeds.event_dir(spark, tables))
    day, place = (F.get_json_object("value", f"$.{name}").cast("int") for name in ("day_index", "row_in_day"))
    late = (day == 5) | ((day == 3) & (place == 0))
    last = day > messages.agg(F.max(day)).first()[0] - 20
    for number, want in enumerate((~late & ~last, ~late & last, late | (day == 0))):
        got, want = spark.read.text(f"{store.root}/feed/{number}"), messages.where(want)
        assert want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
