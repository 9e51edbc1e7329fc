"""Where the live jobs keep their tables and checkpoints, and how all of it is reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillstream import schemas
from tillstream.sources.hot import HotTable
from tillstream.sources.tables import KeyedTable, delete_folder, folder_names
from tillstream.streaming.live import DAY_SCHEMA, KPI_SCHEMA, PROGRESS_SCHEMA, RECENT_SCHEMA


class LiveStore:
    """The live tables of the current generation under ``root``.

    A reset starts a new, empty generation with new checkpoints, so the feed is read from its
    beginning again, and deletes the tables and checkpoints of older ones.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._generations = KeyedTable(spark, f"{root}/generations", "id int, generation long", ["id"])
        self._generation: int | None = None

    @property
    def generation(self) -> int:
        """Read once; a store object that was made before another one's reset stays in the old generation."""
        if self._generation is None:
            row = self._generations.read().first()
            self._generation = row["generation"] if row else 0
        return self._generation

    def _path(self, name: str) -> str:
        return f"{self.root}/generation-{self.generation}/{name}"

    @property
    def hot_path(self) -> str:
        return self._path("hot")

    @property
    def closed_path(self) -> str:
        return self._path("closed_days")

    def checkpoint(self, job: str) -> str:
        return self._path(f"checkpoints/{job}")

    def hot_table(self) -> HotTable:
        return HotTable(self.spark, self.hot_path)

    def hot(self) -> DataFrame:
        """All events."""
        return self.hot_table().read()

    def forecasts(self) -> KeyedTable:
        return KeyedTable(self.spark, self._path("forecasts"), schemas.FORECAST, ["simulated_day"], ["generated_at"])

    def outlook(self) -> KeyedTable:
        return KeyedTable(
            self.spark, self._path("outlook"), schemas.OUTLOOK, ["generated_day", "forecast_date"]
        )

    def status(self) -> KeyedTable:
        return KeyedTable(self.spark, self._path("status"), schemas.STATUS, ["id"])

    def days(self) -> KeyedTable:
        return KeyedTable(self.spark, self._path("days"), DAY_SCHEMA, ["simulated_day"])

    def kpis(self) -> KeyedTable:
        return KeyedTable(self.spark, self._path("kpis"), KPI_SCHEMA)

    def recent(self) -> KeyedTable:
        return KeyedTable(self.spark, self._path("recent"), RECENT_SCHEMA)

    def progress(self) -> KeyedTable:
        return KeyedTable(self.spark, self._path("progress"), PROGRESS_SCHEMA)

    def reset(self, purge: bool = True) -> None:
        """Stop the live jobs first: what still runs in an older generation loses its folders."""
        following = self.generation + 1
        self._generations.write(self.spark.range(1).selectExpr("1 AS id", f"{following} AS generation"))
        self._generations.compact()
        self._generation = following
        if purge:
            for name in folder_names(self.spark, self.root):
                if name.startswith("generation-") and name != f"generation-{following}":
                    delete_folder(self.spark, f"{self.root}/{name}")

    def files(self) -> int:
        """Files that the tables and checkpoints of all generations hold."""
        spark, total = self.spark, 0
        for name in folder_names(spark, self.root):
            if name.startswith("generation-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
                total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getFileCount()
        return total
