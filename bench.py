"""Wall times on the tables in $BENCH_SF_DIR with $BENCH_CPUS cores; prints one JSON line.

``queries`` holds seconds. Loads and streams run once, queries on the loaded stores are the better
of two runs, all rows fetched. ``stream_rows_per_sec`` are rows over the wall time of a stream that
takes in the whole feed, start and stop included.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from checks import feeds  # noqa: E402
from checks.registered import QUERIES  # noqa: E402
from tillstream.session import get_spark, new_folder  # noqa: E402
from tillstream.sources.events import read_event_files  # noqa: E402
from tillstream.sources.live_store import LiveStore  # noqa: E402
from tillstream.streaming import live  # noqa: E402

QUERY_NAMES = [
    "q1_monthly_revenue_trend", "q2_top_products", "q3_customer_rfm_summary", "q4_geo_revenue",
    "q5_daily_sales_series", "q5_daily_sales_series_by_country", "q6_reorder_signals",
    "q7_cohort_retention", "q8_revenue_by_product", "q12_revenue_kpis", "q13_query_summaries",
    "a1_reorder_alerts", "a2_anomaly_alerts", "l1_recent_transactions", "l2_live_top_products",
    "l3_live_geo_revenue", "l4_live_daily_series", "l5_forecast_vs_actual", "l8_accuracy_report",
    "l9_stream_status", "f4_sliding_samples", "f7_forecast", "f11_evaluate_forecaster",
    "r1_warehouse_documents", "r3_top_k_similar", "r3_top_k_documents", "r4_answer_questions",
    "d9_check_constraints",
]


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(
        "bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=str(cpus),
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}

    def fill(name: str, store) -> None:
        """Time the job that fills a store; later queries read it."""
        seconds[name] = timed(lambda: store(spark, sf_dir))

    feeds.csv_dir(spark, sf_dir)
    fill("s4_ingest", feeds.lake_dir)
    fill("s5_load_warehouse", feeds.star)
    events = feeds.event_dir(spark, sf_dir)
    num_events = spark.read.text(events).count()

    fill("s7_write_hot_events", feeds.live_store)
    store = LiveStore(spark, new_folder(spark, "bench-live"))

    def stream(name: str, run) -> None:
        seconds[name] = timed(lambda: live.drain(run(read_event_files(spark, events))))

    stream("t1_running_kpis", lambda e: live.running_kpis(
        e, store.kpis(), store.checkpoint("kpis"), once=True))
    stream("t4_close_days", lambda e: live.close_days(
        e, store.closed_path, store.checkpoint("close"), once=True))
    stream("t3_recent_ring", lambda e: live.recent_ring(
        e, store.recent(), store.checkpoint("recent"), once=True))
    stream("t6_day_progress", lambda e: live.day_progress(
        e, store.progress(), store.checkpoint("progress"), once=True))
    for name in ("s7_write_hot_events", "t1_running_kpis", "t4_close_days", "t3_recent_ring", "t6_day_progress"):
        rates[name] = num_events / seconds[name]

    feeds.closed_days(spark, sf_dir)
    feeds.daily_series(spark, sf_dir)
    fill("f6_fit_forecaster", feeds.forecaster)
    fill("r2_index_documents", feeds.document_index)

    for name in QUERY_NAMES:
        seconds[name] = min(timed(lambda: QUERIES[name](spark, sf_dir).toArrow()) for _ in range(2))

    result = {
        "metric": "total_wall_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "num_events": num_events,
        "stream_rows_per_sec": {name: round(rate) for name, rate in rates.items()},
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
