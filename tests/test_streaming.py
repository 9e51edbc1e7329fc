"""Streams give what a batch over the same events gives."""

import json
import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from checks import feeds
from checks.registered import QUERIES
from tests.helpers import values
from tillstream.operators.forecast import fit_forecaster, forecast, recent_mean, scale_correction
from tillstream.plans import live as live_plans
from tillstream.session import new_folder
from tillstream.sources.events import distinct_events, hot_events, parse_events, read_event_files
from tillstream.sources.live_store import LiveStore
from tillstream.sources.tables import folder_names
from tillstream.streaming import live
from tillstream.streaming.forecasts import TOTAL, forecast_on_day_start, forecast_rows, late_totals
from tillstream.streaming.live import drain


def event(day, place, revenue=1.0, hour=8, customer="7", country="Spain"):
    return {
        "invoice": f"{day}-{place // 2}", "stock_code": f"S{place % 3}", "description": "d",
        "quantity": 2.5, "price": 1.0, "revenue": revenue, "customer_id": customer,
        "country": country, "invoice_date": f"{day} {hour:02}:{place:02}:00", "simulated_day": day,
        "day_index": 0, "is_day_start": place == 0, "is_day_end": False, "row_in_day": place,
        "total_in_day": 9,
    }


DAYS = [f"2020-01-{d:02}" for d in range(1, 7)]


def feed(folder, order=None):
    """One file per day, modified in the given order."""
    os.makedirs(folder, exist_ok=True)
    for place, day in enumerate(order or DAYS):
        rows = [event(day, i, revenue=1.25 * (i + 1), country="Spain" if i % 2 else "Italy",
                      customer="nan" if i == 3 else f"c{i}") for i in range(9)]
        path = os.path.join(folder, f"{day}.json")
        with open(path, "w") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (1_600_000_000 + place * 10, 1_600_000_000 + place * 10))
    return str(folder)


@pytest.fixture
def store(spark):
    return LiveStore(spark, new_folder(spark, "live"))


def take_in(spark, store, folder, files=None):
    events = read_event_files(spark, folder, files)
    drain(live.write_hot_events(events, store.hot_path, store.checkpoint("hot"), once=True))
    return store.hot()


def test_messages_are_parsed(spark):
    rows = spark.createDataFrame(
        [(json.dumps(event("2020-01-01", 0, customer="nan")),), ("no json",)], "value string"
    )
    got = parse_events(rows).collect()
    assert len(got) == 1 and got[0]["customer_id"] == "GUEST"
    assert got[0]["simulated_day"] == date(2020, 1, 1)


def test_kpis_equal_the_batch_and_survive_a_restart(spark, store, tmp_path):
    folder = feed(tmp_path / "in")
    events = read_event_files(spark, folder, 2)
    drain(live.running_kpis(events, store.kpis(), store.checkpoint("kpis"), once=True))
    first = store.kpis().read().first()
    assert first["total_txns"] == 54 and first["total_units"] == 108 and first["countries"] == 2
    assert first["total_live_revenue"] == 6 * 1.25 * 45 and first["unique_customers"] == 9
    # A day more, taken up from the checkpoint.
    with open(os.path.join(folder, "2020-01-07.json"), "w") as f:
        f.write(json.dumps(event("2020-01-07", 0, revenue=0.5)) + "\n")
    events = read_event_files(spark, folder, 2)
    drain(live.running_kpis(events, store.kpis(), store.checkpoint("kpis"), once=True))
    again = store.kpis().read().first()
    assert again["total_txns"] == 55 and again["total_live_revenue"] == first["total_live_revenue"] + 0.5


def test_restart_without_new_files_adds_nothing(spark, store, tmp_path):
    folder = feed(tmp_path / "in")
    assert take_in(spark, store, folder, 2).count() == 54
    assert take_in(spark, store, folder, 2).count() == 54


def test_a_repeated_file_counts_once(spark, store, tmp_path):
    folder = feed(tmp_path / "in")
    with open(os.path.join(folder, f"{DAYS[2]}.json")) as f, open(os.path.join(folder, "again.json"), "w") as g:
        g.write(f.read())
    events = read_event_files(spark, folder)
    drain(live.write_hot_events(events, store.hot_path, store.checkpoint("hot"), once=True, distinct=True))
    assert store.hot().count() == 54
    other = LiveStore(spark, new_folder(spark, "live"))
    raw_hot = take_in(spark, other, folder)
    assert raw_hot.count() == 63 and distinct_events(raw_hot).count() == 54


def whole_days(closed, hot):
    end = F.date_add("simulated_day", 1).cast("timestamp")
    return live.with_open(closed, live.day_totals(hot), end, hot.agg(F.max("invoice_date")).scalar(), "1 hour")


def test_days_close_and_the_last_one_by_batch(spark, store, tmp_path):
    folder = feed(tmp_path / "in")
    drain(live.close_days(read_event_files(spark, folder, 1), store.closed_path, store.checkpoint("c"), once=True))
    closed = spark.read.schema(live.DAY_SCHEMA).parquet(store.closed_path)
    assert sorted(str(d) for d, in values(closed, "simulated_day")) == DAYS[:-1]
    hot = take_in(spark, store, folder)
    whole = whole_days(closed, hot)
    assert sorted((str(d), c) for d, c in values(whole, "simulated_day", "closed_by_stream")) == [
        *((d, True) for d in DAYS[:-1]), (DAYS[-1], False)
    ]
    assert whole.drop("closed_by_stream").exceptAll(live.day_totals(hot)).isEmpty()
    # A stream that closed nothing is not made whole.
    assert [str(d) for d, in values(whole_days(closed.limit(0), hot), "simulated_day")] == DAYS[-1:]


def test_shuffled_files_give_the_same_totals(spark, store, tmp_path):
    order = DAYS[:]
    random.Random(3).shuffle(order)
    folder = feed(tmp_path / "in", order)
    events = read_event_files(spark, folder)
    drain(live.close_days(events, store.closed_path, store.checkpoint("c"), once=True))
    closed = spark.read.schema(live.DAY_SCHEMA).parquet(store.closed_path)
    hot = take_in(spark, store, folder)
    assert whole_days(closed, hot).drop("closed_by_stream").exceptAll(live.day_totals(hot)).isEmpty()


def test_an_empty_throughput_stream_shows(spark):
    times = spark.createDataFrame([(i,) for i in range(60)], "s long").select(
        F.timestamp_seconds("s").alias("ts"))
    counts = live.window_counts(times, "ts")
    whole = live.with_open(
        counts.limit(0), counts, F.col("window_start") + F.expr("INTERVAL 1 second"),
        times.agg(F.max("ts")).scalar(), "10 seconds")
    assert whole.count() == 11 and counts.count() == 60


def test_an_event_without_time_counts_in_its_day(spark, store, tmp_path):
    folder = feed(tmp_path / "in")
    with open(os.path.join(folder, "no-time.json"), "w") as f:
        f.write(json.dumps(event(DAYS[2], 30, revenue=3.0) | {"invoice_date": "unknown"}) + "\n")
    drain(live.close_days(read_event_files(spark, folder), store.closed_path, store.checkpoint("c"), once=True))
    closed = spark.read.schema(live.DAY_SCHEMA).parquet(store.closed_path)
    assert values(closed.where(F.col("simulated_day") == DAYS[2]), "num_events", "actual_revenue") == [(10, 59.25)]


def test_days_close_in_utc_only(spark, store, tmp_path):
    events = read_event_files(spark, feed(tmp_path / "in"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError):
            live.closing_days(events)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_late_event_is_corrected_from_the_hot_table(spark, store, tmp_path):
    folder = feed(tmp_path / "in")
    drain(live.close_days(read_event_files(spark, folder, 1), store.closed_path, store.checkpoint("c"), once=True))
    with open(os.path.join(folder, "late.json"), "w") as f:
        f.write(json.dumps(event(DAYS[0], 20, revenue=1000.0)) + "\n")
    drain(live.close_days(read_event_files(spark, folder, 1), store.closed_path, store.checkpoint("c"), once=True))
    closed = spark.read.schema(live.DAY_SCHEMA).parquet(store.closed_path)
    first_day = F.col("simulated_day") == DAYS[0]
    assert values(closed.where(first_day), "actual_revenue", "num_events") == [(56.25, 9)]
    hot = take_in(spark, store, folder)
    assert hot.where(first_day).count() == 10
    store.days().write(closed)
    live.correct_days(store.days(), store.hot_table())
    assert values(store.days().read().where(first_day), "actual_revenue", "num_events") == [(1056.25, 10)]
    assert store.days().read().count() == len(DAYS) - 1


def test_late_events_and_late_days_reach_all_readers_and_forecasts(spark, store, tmp_path):
    folder, later = feed(tmp_path / "in"), tmp_path / "later"
    os.makedirs(later)
    os.rename(os.path.join(folder, f"{DAYS[2]}.json"), later / "day.json")  # comes late as a whole
    os.rename(os.path.join(folder, f"{DAYS[5]}.json"), later / "last.json")
    history = spark.createDataFrame(
        [(date(2019, 9, 1) + timedelta(days=i), 50.0 + i % 7, 10 + i % 7, 5) for i in range(122)],
        "ds date, y double, units long, orders long",
    )
    model = fit_forecaster(history.withColumn("series", F.lit(TOTAL)))

    def run():
        events = read_event_files(spark, folder, 1)
        drain(live.close_days(events, store.closed_path, store.checkpoint("c"), once=True))
        drain(forecast_on_day_start(events, store, history, model, once=True))

    def read(days):
        return {str(d): v for d, v in values(days, "simulated_day", "actual_revenue")}

    take_in(spark, store, folder)
    run()
    assert sorted(read(store.days().read())) == [DAYS[0], DAYS[1], DAYS[3]]
    os.rename(later / "day.json", os.path.join(folder, "late-day.json"))
    with open(os.path.join(folder, "late.json"), "w") as f:
        f.write(json.dumps(event(DAYS[0], 20, revenue=1000.0)) + "\n")
    os.rename(later / "last.json", os.path.join(folder, "last.json"))
    hot = take_in(spark, store, folder)
    run()
    closed = spark.read.schema(live.DAY_SCHEMA).parquet(store.closed_path)
    assert sorted(read(closed)) == [DAYS[0], DAYS[1], DAYS[3], DAYS[4]] and read(closed)[DAYS[0]] == 56.25
    right = read(live.day_totals(hot))
    assert right[DAYS[0]] == 1056.25 and read(live_plans.current_days(closed, store.hot_table().day_counts())) == right
    stored = store.days().read()
    assert read(stored) == {day: right[day] for day in DAYS[:5]}
    assert stored.exceptAll(live.day_totals(hot)).isEmpty()


def test_a_hot_table_that_is_behind_lowers_no_stored_day(spark, store, tmp_path):
    hot = take_in(spark, store, feed(tmp_path / "in"))
    days = live.day_totals(hot).where(F.col("simulated_day") < DAYS[4])
    assert late_totals(days, store.hot_table()) is None
    more = days.withColumn("num_events", F.col("num_events") + 2)
    assert late_totals(more, store.hot_table()).isEmpty()


def send(spark, store, folder, name, events, **options):
    """A file more, taken up after a restart."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("".join(json.dumps(e) + "\n" for e in events))
    source = read_event_files(spark, str(folder))
    drain(live.write_hot_events(source, store.hot_path, store.checkpoint("hot"), once=True, **options))


def test_repeats_late_and_untimed_events_count_once(spark, store, tmp_path):
    folder = tmp_path / "in"
    untimed = event(DAYS[0], 5) | {"invoice_date": "unknown"}
    no_place = event(DAYS[0], 6) | {"row_in_day": None}
    send(spark, store, folder, "1.json", [event(DAYS[5], 0), event(DAYS[0], 1), untimed, untimed, no_place], distinct=True)
    late = [event("2019-03-01", i) for i in range(3)]  # long before the watermark of any stream
    send(spark, store, folder, "2.json", [untimed, event(DAYS[0], 1), event(DAYS[5], 1), *late], distinct=True)
    send(spark, store, folder, "3.json", [*late, untimed, event(DAYS[5], 0), event(DAYS[5], 2)], distinct=True)
    found = sorted((str(d), p if p is not None else -1) for d, p in values(store.hot(), "simulated_day", "row_in_day"))
    assert found == sorted(
        [(DAYS[0], 1), (DAYS[0], 5), (DAYS[0], -1), (DAYS[5], 0), (DAYS[5], 1), (DAYS[5], 2), *[("2019-03-01", i) for i in range(3)]]
    )
    assert store.hot_table().day_counts().exceptAll(
        store.hot().groupBy("sale_month", "simulated_day").agg(
            F.count("*").alias("num_events"), F.sum("revenue").alias("actual_revenue"), F.sum(F.lit(2)).alias("units"))
    ).isEmpty()


def test_a_batch_that_comes_again_replaces_itself(spark, store, tmp_path):
    folder, table = feed(tmp_path / "in"), store.hot_table()
    rows = hot_events(parse_events(spark.read.text(folder)))
    first, rest = rows.where(F.col("simulated_day") < DAYS[3]), rows.where(F.col("simulated_day") >= DAYS[2])
    for distinct, total in ((True, 54), (False, 63)):
        table.append(first, "run", 0, distinct)
        table.append(rest.where("row_in_day < 4"), "run", 1, distinct)  # a first try that had less
        table.append(rest, "run", 1, distinct)
        assert table.read().count() == total
        assert table.day_counts().agg(F.sum("num_events")).first()[0] == total
        assert table.arrivals().count() == 2


def test_closed_months_are_rewritten_and_their_batches_retired(spark, store, tmp_path):
    folder, table = tmp_path / "in", store.hot_table()
    days = [f"20{20 + m // 12}-{m % 12 + 1:02}-15" for m in range(14)]
    for number in range(3):
        send(spark, store, folder, f"{number}.json", [event(d, p) for d in days for p in range(number * 4, number * 4 + 4)])
    before = sorted(values(store.hot(), "simulated_day", "row_in_day"))
    table.close_months(202101)
    assert sorted(values(store.hot(), "simulated_day", "row_in_day")) == before and len(before) == 14 * 12
    assert table.stale_folders() == 0
    late = [event(days[0], 50), event(days[0], 3), event(days[13], 50)]
    send(spark, store, folder, "late.json", late, distinct=True)
    want = sorted([*before, *[(date.fromisoformat(e["simulated_day"]), e["row_in_day"]) for e in late if e["row_in_day"] == 50]])
    assert sorted(values(store.hot(), "simulated_day", "row_in_day")) == want
    table.close_months(202101)
    table.close_months(202101)  # nothing to do
    assert sorted(values(store.hot(), "simulated_day", "row_in_day")) == want and table.stale_folders() == 0
    plan = store.hot()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2
    months = [n for v in folder_names(spark, f"{table.path}/months") for n in folder_names(spark, f"{table.path}/months/{v}")]
    assert sorted(m for m in months if m.startswith("sale_month")) == [f"sale_month=2020{m:02}" for m in range(1, 13)]


def test_months_whose_batches_were_not_deleted_count_once(spark, store, tmp_path):
    table = store.hot_table()
    rows = hot_events(parse_events(spark.read.text(feed(tmp_path / "in"))))
    table.append(rows, "run", 0)
    table.close_months(202002)
    rows.write.partitionBy("sale_month").mode("overwrite").parquet(f"{table.path}/batches/run=run/batch=0")  # as if it had stopped
    assert table.read().count() == 54 and table.stale_folders() == 1
    table.close_months(202002)
    assert table.read().count() == 54 and table.stale_folders() == 0


def test_nothing_late_reads_no_event(spark, store, tmp_path):
    take_in(spark, store, feed(tmp_path / "in"))
    closed = live.day_totals(store.hot())
    assert live.corrected_days(closed, store.hot_table()) is None
    stored = spark.createDataFrame(closed.collect(), live.DAY_SCHEMA)
    days = live_plans.current_days(stored, store.hot_table().day_counts())
    plan = days._jdf.queryExecution().optimizedPlan().toString()
    assert "stock_code" not in plan and "invoice" not in plan and "Relation" in plan


def test_recent_list_and_progress(spark, store, tmp_path):
    folder = feed(tmp_path / "in")
    drain(live.recent_ring(read_event_files(spark, folder, 1), store.recent(), store.checkpoint("r"), 12, True))
    got = values(live.newest(store.recent().read(), 12), "simulated_day", "row_in_day")
    assert store.recent().read().count() == 12
    assert [(str(d), r) for d, r in got] == (
        [(DAYS[5], r) for r in range(8, -1, -1)] + [(DAYS[4], r) for r in (8, 7, 6)]
    )
    drain(live.day_progress(read_event_files(spark, folder, 1), store.progress(), store.checkpoint("p"), True))
    assert values(store.progress().read(), "current_day", "total_rows") == [(date(2020, 1, 6), 54)]


def test_no_events_give_empty_tables(spark, store, tmp_path):
    os.makedirs(tmp_path / "in")
    assert take_in(spark, store, str(tmp_path / "in")).count() == 0
    kpis = live.kpis_of(live.country_figures(store.hot())).first()
    assert kpis["total_live_revenue"] == 0 and kpis["total_txns"] == 0 and kpis["avg_txn_value"] == 0


def test_sum_over_days_is_the_total(spark, store, tmp_path):
    hot = take_in(spark, store, feed(tmp_path / "in"))
    total = live.kpis_of(live.country_figures(hot)).first()["total_live_revenue"]
    assert live.day_totals(hot).agg(F.sum("actual_revenue")).first()[0] == total


def test_a_forecast_for_each_day_that_opens(spark, store, tmp_path):
    folder = feed(tmp_path / "in")
    history = spark.createDataFrame(
        [(date(2019, 9, 1) + timedelta(days=i), 50.0 + i % 7, 10 + i % 7, 5) for i in range(124)],
        "ds date, y double, units long, orders long",
    )
    model = fit_forecaster(history.withColumn("series", F.lit(TOTAL)))

    def run(files):
        drain(forecast_on_day_start(
            read_event_files(spark, folder, files), store, history, model, once=True))

    run(2)
    opened = [date(2020, 1, d) for d in range(2, 7)]
    made = store.forecasts().read().orderBy("simulated_day")
    assert [r["simulated_day"] for r in made.collect()] == opened
    outlook = store.outlook().read()
    assert {(r["generated_day"], r["count"]) for r in outlook.groupBy("generated_day").count().collect()} == {
        (day, 7) for day in opened}
    assert outlook.where("lower_ci > predicted_revenue OR upper_ci < predicted_revenue").count() == 0
    score = live_plans.mean_error(made, store.days().read()).first()
    assert score["days_streamed"] == 4 and score["mape"] < 50
    run(2)  # nothing new: the stored rows stay
    assert store.forecasts().read().exceptAll(made).isEmpty()


def test_forecasts_with_history_are_those_of_a_batch(spark):
    tables = "/root/testdata/sf0.001"
    got = QUERIES["t8_forecast_with_history"](spark, tables).collect()
    daily = feeds.daily_series(spark, tables).where(F.col("series") == TOTAL)
    newest = daily.agg(F.max("ds")).first()[0]
    origins = daily.where((F.col("ds") >= newest - timedelta(days=20)) & (F.col("ds") < newest)).select("series", "ds")
    made = forecast(daily, feeds.forecaster(spark, tables), origins)
    rows = forecast_rows(scale_correction(made, recent_mean(daily, origins)))
    want = {str(r["simulated_day"]): r for r in rows.collect()}
    assert want and sorted(r["day"] for r in got) == sorted(want) and all(r["in_order"] for r in got)
    for r in got:
        for name, value in (("predicted", "predicted_revenue"), ("lower_ci", "lower_ci"), ("upper_ci", "upper_ci")):
            assert r[name] == pytest.approx(want[r["day"]][value], abs=0.011)
