"""The hot table: all events by month, with additive counters of its days.

A batch is a folder named by its stream's run and its number, so a repeated batch replaces itself, and
counts what it stored by day: readers add these few rows up in place of the events. ``close_months``
rewrites whole months, sorted by day and time, and retires the batches' folders of these months; events that
come later for such a month are read beside it until it is rewritten once more.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream import schemas
from tillstream.functions.columns import cents
from tillstream.sources.tables import KeyedTable, delete_folder, folder_names, publish_folder

COUNTERS = (
    "sale_month int, simulated_day date, num_events long, earned long, units long, "
    "ingested_at timestamp"
)
_BATCH = "run string, batch long"
_EVENT = ["simulated_day", "row_in_day"]
# Days whose places are compared with the stored ones day by day; of more days all places are read.
_RANGES = 64
# Repeated places that are broadcast; more meet the events by a shuffle.
_BROADCAST = 500_000


class HotTable:
    """One stream at a time appends; anyone reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        # Which version of a month holds which batches of each run.
        self._closed = KeyedTable(
            spark, f"{path}/closed", "sale_month int, version string, of_run string, until long", ["sale_month", "of_run"]
        )

    def _part(self, name: str, schema: str) -> DataFrame:
        if not folder_names(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _of_batch(self, name: str, run: str, batch: int) -> str:
        return f"{self.path}/{name}/run={run}/batch={batch}"

    def append(self, events: DataFrame, run: str, batch: int, distinct: bool = False) -> None:
        """Store a batch of events and its counters; with ``distinct`` only events that are not there yet."""
        place = self._of_batch("batches", run, batch)
        if not distinct:
            self._write(events, place)
        else:
            # Stored apart first, so that a batch is parsed once; readers do not look there.
            apart = self._of_batch("arriving", run, batch)
            self._write(events, apart)
            came = self.spark.read.schema(schemas.HOT_EVENT).parquet(apart)
            met = self._met(came.where(F.col("row_in_day").isNotNull()).select("sale_month", *_EVENT), run, batch).persist()
            new = self._unseen(came, met)
            if new is came:
                publish_folder(self.spark, apart, place)
            else:
                self._write(new, place)
                delete_folder(self.spark, apart)
            met.unpersist()
        stored = self.spark.read.schema(schemas.HOT_EVENT).parquet(place)
        counted = stored.groupBy("sale_month", "simulated_day").agg(
            F.count("*").alias("num_events"), F.sum(cents(F.col("revenue"))).alias("earned"),
            F.sum(F.col("quantity").cast("long")).alias("units"),
            F.max("ingested_at").alias("ingested_at"),
        )
        counted.coalesce(1).write.mode("overwrite").parquet(self._of_batch("counters", run, batch))

    def _write(self, events: DataFrame, path: str) -> None:
        # A repeated batch replaces all months of its first try.
        writer = events.write.option("partitionOverwriteMode", "static").option("compression", "zstd").mode("overwrite")
        writer.partitionBy("sale_month").parquet(path)

    def _met(self, places: DataFrame, run: str, batch: int) -> DataFrame:
        """(met_day, met_row, is_stored): the places that an earlier batch stored, and those that the
        batch has more than once.

        However late an event comes, it meets the stored places of its own day: months without such a day
        are not listed, and files whose places lie elsewhere are skipped by their statistics.
        """
        days = places.groupBy("sale_month", "simulated_day").agg(
            F.min("row_in_day").alias("low"), F.max("row_in_day").alias("high")
        ).collect()  # a row per day of the batch
        stored = self.read(before=(run, batch)).where(F.col("sale_month").isin(sorted({d["sale_month"] for d in days})))
        if 0 < len(days) <= _RANGES:
            stored = stored.where(reduce(or_, [
                (F.col("simulated_day") == d["simulated_day"]) & F.col("row_in_day").between(d["low"], d["high"]) for d in days
            ]))
        arrived = places.select(*_EVENT, F.lit(1).alias("arrived"))
        compared = arrived.unionByName(stored.select(*_EVENT, F.lit(0).alias("arrived")))
        counted = compared.groupBy(*_EVENT).agg(F.sum("arrived").alias("times"), F.min("arrived").alias("least"))
        is_stored = (F.col("least") == 0) & F.col("simulated_day").isNotNull()
        return counted.where((F.col("times") > 0) & (is_stored | (F.col("times") > 1))).select(
            F.col("simulated_day").alias("met_day"), F.col("row_in_day").alias("met_row"), is_stored.alias("is_stored")
        )

    def _unseen(self, events: DataFrame, met: DataFrame) -> DataFrame:
        """The events that no earlier batch stored, once each; day and place name an event.

        An event without a place cannot be told from others and is always taken. Only repeated events are
        brought together; where none was met, the batch is stored as it came.
        """
        counted = met.agg(F.count("*").alias("all"), F.count_if(F.col("is_stored")).alias("stored")).first()
        if not counted["all"]:
            return events
        known = F.broadcast(met) if counted["all"] <= _BROADCAST else met
        same = F.col("simulated_day").eqNullSafe(F.col("met_day")) & (F.col("row_in_day") == F.col("met_row"))
        new = events.join(known, same, "left_anti")
        if counted["all"] == counted["stored"]:
            return new
        repeated = known.where(~F.col("is_stored"))
        return new.unionByName(events.join(repeated, same, "left_semi").dropDuplicates(_EVENT))

    def _retired(self, closed: list) -> Column | None:
        """Whether a batch's event is in a rewritten month's version."""
        months: dict[tuple[str, int], list[int]] = defaultdict(list)
        for row in closed:
            months[row["of_run"], row["until"]].append(row["sale_month"])
        found = [
            (F.col("run") == run) & (F.col("batch") <= until) & F.col("sale_month").isin(which)
            for (run, until), which in months.items()
        ]
        return reduce(or_, found) if found else None

    def read(self, before: tuple[str, int] | None = None) -> DataFrame:
        """All events, or those that a batch of a run found when it came first. At most two tables are read:
        the rewritten months, and the batches' other events."""
        columns = self.spark.createDataFrame([], schemas.HOT_EVENT).columns
        open_part = self._part("batches", f"{schemas.HOT_EVENT}, {_BATCH}")
        if before is not None:
            open_part = open_part.where(~((F.col("run") == before[0]) & (F.col("batch") >= before[1])))
        closed = self._closed.read().collect()  # a row per rewritten month and run
        if not closed:
            return open_part.select(*columns)
        versions = sorted({f"{row['sale_month']}/{row['version']}" for row in closed})
        whole = self._part("months", f"{schemas.HOT_EVENT}, version string").where(
            F.concat_ws("/", F.col("sale_month").cast("string"), "version").isin(versions)
        )
        return whole.select(*columns).unionByName(open_part.where(~self._retired(closed)).select(*columns))

    def counters(self) -> DataFrame:
        """A row per batch and day: its events, revenue in cents, units and arrival."""
        return self._part("counters", f"{COUNTERS}, {_BATCH}")

    def day_counts(self) -> DataFrame:
        """(sale_month, simulated_day, num_events, actual_revenue, units): the days' totals, added up from the
        batches' counters. No event is read."""
        return self.counters().groupBy("sale_month", "simulated_day").agg(
            F.sum("num_events").alias("num_events"), (F.sum("earned") / 100.0).alias("actual_revenue"),
            F.sum("units").alias("units"),
        )

    def arrivals(self) -> DataFrame:
        """(ingested_at, num_events) of each batch that has events."""
        return self.counters().groupBy("run", "batch").agg(
            F.max("ingested_at").alias("ingested_at"), F.sum("num_events").alias("num_events")
        ).select("ingested_at", "num_events")

    def close_months(self, before: int) -> None:
        """Rewrite the months before a month (yyyymm) that have batches' events, and retire these.

        A month's version counts once its record is written, and from then on the batches it was made of
        do not. What a failed try left is never read; a later call deletes what should be gone.
        """
        done = self.counters().groupBy("run").agg(F.max("batch").alias("until")).collect()  # a row per run
        closed = self._closed.read().collect()
        columns = self.spark.createDataFrame([], schemas.HOT_EVENT).columns
        if done:
            whole_batches = reduce(or_, [(F.col("run") == r["run"]) & (F.col("batch") <= r["until"]) for r in done])
            fresh = self._part("batches", f"{schemas.HOT_EVENT}, {_BATCH}").where(whole_batches & (F.col("sale_month") < before))
            retired = self._retired(closed)
            if retired is not None:
                fresh = fresh.where(~retired)
            months = sorted(r["sale_month"] for r in fresh.select("sale_month").distinct().collect())
            if months:
                version = uuid.uuid4().hex
                kept = [f"{r['sale_month']}/{r['version']}" for r in closed if r["sale_month"] in months]
                old = self._part("months", f"{schemas.HOT_EVENT}, version string").where(
                    F.concat_ws("/", F.col("sale_month").cast("string"), "version").isin(kept)
                )
                old.select(*columns).unionByName(fresh.select(*columns)).hint("rebalance", "sale_month").sortWithinPartitions(
                    "sale_month", "simulated_day", "invoice_date", "invoice"
                ).write.partitionBy("sale_month").parquet(f"{self.path}/months/version={version}")
                record = [(month, version, r["run"], r["until"]) for month in months for r in done]
                self._closed.write(self.spark.createDataFrame(record, self._closed.schema))
        self._clear()

    def _clear(self) -> None:
        """Delete retired batches' folders, replaced versions and tries that left no record."""
        closed = self._closed.read().collect()
        until = {(r["sale_month"], r["of_run"]): r["until"] for r in closed}
        versions = {(r["sale_month"], r["version"]) for r in closed}
        for run in folder_names(self.spark, f"{self.path}/batches"):
            for batch in folder_names(self.spark, f"{self.path}/batches/{run}"):
                folder = f"{self.path}/batches/{run}/{batch}"
                for month in folder_names(self.spark, folder):
                    if month.startswith("sale_month="):
                        last = until.get((int(month.split("=")[1]), run.split("=")[1]), -1)
                        if int(batch.split("=")[1]) <= last:
                            delete_folder(self.spark, f"{folder}/{month}")
        for version in folder_names(self.spark, f"{self.path}/months"):
            for month in folder_names(self.spark, f"{self.path}/months/{version}"):
                if month.startswith("sale_month=") and (int(month.split("=")[1]), version.split("=")[1]) not in versions:
                    delete_folder(self.spark, f"{self.path}/months/{version}/{month}")

    def stale_folders(self) -> int:
        """Batches' folders of months that are rewritten."""
        closed = {(r["sale_month"], r["of_run"]): r["until"] for r in self._closed.read().collect()}
        left = self._part("batches", f"{schemas.HOT_EVENT}, {_BATCH}").select("sale_month", "run", "batch").distinct()
        return sum(r["batch"] <= closed.get((r["sale_month"], r["run"]), -1) for r in left.collect())
