"""Small keyed tables on plain Parquet, and JSON report files.

A write goes to a folder of its own, numbered one above all that are there, so the order of writes does not
depend on a clock. Each row carries the run and the batch that wrote it: a stream's run is the id of
its checkpoint, so a new checkpoint never meets an old one's batches. A reader takes the newest row of
each key, or of a table without keys the rows of the newest write. ``compact`` leaves what readers and a
repeat of the newest batch need in one folder, ``purge`` nothing. A table has one writer at a time; who
reads while ``compact`` or ``purge`` deletes has to read again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a write adds to its rows. Each write has one marker row, so that an empty one is seen too.
_ADDED = "written long, marker boolean, run string, batch long"
# A stream's batches after which its tables are compacted.
COMPACT_EVERY = 100


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_folder(spark: SparkSession, path: str) -> None:
    files, target = _folder(spark, path)
    files.delete(target, True)


def publish_folder(spark: SparkSession, path: str, target: str) -> None:
    """Give a written folder its place, in which readers look; one that is there is replaced."""
    files, source = _folder(spark, path)
    place = _folder(spark, target)[1]
    files.delete(place, True)
    files.mkdirs(place.getParent())
    if not files.rename(source, place):
        raise OSError(f"{path} could not be renamed to {target}")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a path; none where it does not exist."""
    files, target = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a path whose write has ended."""
    files, target = _folder(spark, f"{path}/*/_SUCCESS")
    return sorted(s.getPath().getParent().getName() for s in files.globStatus(target) or [])


def stream_run(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint: the same after a restart, new in a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


class KeyedTable:
    """``newest_by`` orders rows of one key within one write; the other columns break ties."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: Sequence[str] = (), newest_by: Sequence[str] = ()
    ):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.newest_by = list(keys), list(newest_by)

    def _folders(self) -> list[str]:
        """The folders that count: the newest compaction, and the writes after it."""
        done = finished_folders(self.spark, self.path)
        compacted = [name for name in done if name.startswith("compacted-")][-1:]
        after = compacted[0].split("-")[1] if compacted else ""
        return compacted + [name for name in done if name.startswith("write-") and name.split("-")[1] > after]

    def _stored(self) -> DataFrame:
        schema = f"{self.schema}, {_ADDED}"
        paths = [f"{self.path}/{name}" for name in self._folders()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, stored: DataFrame) -> DataFrame:
        if not self.keys:
            last = stored.agg(F.max("written").alias("last")).scalar()
            return stored.where(F.col("written") == last)
        columns = [c.split()[0] for c in self.schema.split(", ")]
        order = ["written", *self.newest_by]
        order += [c for c in columns if c not in [*self.keys, *order]]
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in order]))
        rows = stored.where(~F.col("marker")).withColumn("place", place)
        return rows.where(F.col("place") == 1).drop("place")

    def read(self, before: tuple[str, int] | None = None) -> DataFrame:
        """The current rows; with ``before`` those that a batch of a run found when it came first."""
        stored = self._stored()
        if before is not None:
            stored = stored.where(~((F.col("run") == before[0]) & (F.col("batch") >= before[1])))
        columns = self.spark.createDataFrame([], self.schema).columns
        return self._newest(stored).where(~F.col("marker")).select(*columns)

    def write(self, rows: DataFrame, run: str | None = None, batch: int = 0) -> None:
        """Add a write: its rows replace those of their keys, or without keys all rows."""
        names = folder_names(self.spark, self.path)
        number = 1 + max((int(name.split("-")[1]) for name in names), default=0)
        wanted = self.spark.createDataFrame([], self.schema).schema
        marker = self.spark.range(1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted], F.lit(True).alias("marker")
        )
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
        typed.withColumn("marker", F.lit(False)).unionByName(marker).withColumns(
            {
                "written": F.lit(number).cast("long"), "run": F.lit(run or uuid.uuid4().hex),
                "batch": F.lit(batch).cast("long"),
            }
        ).write.parquet(f"{self.path}/write-{number:012}")

    def compact(self) -> None:
        """Store in one folder what readers need, and what the newest batch would need if it came again; then
        delete the others. The folder counts once it is whole, and then what it replaces does not."""
        folders = self._folders()
        if len(folders) < 2:
            return
        stored = self._stored()
        last = stored.agg(F.max(F.struct("written", "run", "batch")).alias("last")).first()["last"]
        newest_batch = (F.col("run") == last["run"]) & (F.col("batch") >= last["batch"])
        # The marker of a table's last write tells its number, run and batch also where it has no rows.
        keep = self._newest(stored).unionByName(self._newest(stored.where(~newest_batch))).unionByName(
            stored.where(F.col("marker") & (F.col("written") == last["written"]))
        ).distinct()
        keep.write.parquet(f"{self.path}/compacted-{last['written']:012}-{uuid.uuid4().hex}")
        for name in folders:
            delete_folder(self.spark, f"{self.path}/{name}")

    def tidy(self, batch: int) -> None:
        """Compact now and then; a stream's job calls it before it reads the table."""
        if batch and batch % COMPACT_EVERY == 0:
            self.compact()

    def purge(self) -> None:
        """Delete all rows and give their space back."""
        delete_folder(self.spark, self.path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
