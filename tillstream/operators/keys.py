"""Dense surrogate keys without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.session import scratch_folder

# monotonically_increasing_id() keeps the partition number above this many bits of row position.
_POSITION_BITS = 33


# More than any file has.
_WHOLE = str(1 << 40)


def short_origin(rows: DataFrame) -> DataFrame:
    """A hash in place of the path of a row's source file, which is longer than the rest of the row.

    As the last part of an order it does what the path does: it keeps rows that are alike in all else apart."""
    return rows.withColumn("source_file", F.xxhash64("source_file")) if "source_file" in rows.columns else rows


def _file_per_task(spark: SparkSession) -> SparkSession:
    """A session that reads every file as a whole, in a task of its own."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE)
    own.conf.set("spark.sql.files.openCostInBytes", _WHOLE)
    return own


def stored_by_task(rows: DataFrame, label: str) -> DataFrame:
    """Store the rows of every task, and read them back so that a task has again all rows of one."""
    spark = rows.sparkSession
    path = scratch_folder(spark, label)
    rows.write.option("compression", "zstd").parquet(path)
    return _file_per_task(spark).read.schema(rows.schema).parquet(path)


def place_rows(
    df: DataFrame, order_by: list[str], label: str, drop: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """Sort over all tasks and store every row, without the columns of ``drop``, with its partition and its row in
    the partition. With ``tasks`` the rows are cut into so many partitions, and one task reads one of them."""
    spark = df.sparkSession
    path = scratch_folder(spark, f"placed-{label}")
    ordered = df.repartitionByRange(tasks, *order_by).sortWithinPartitions(*order_by) if tasks else df.orderBy(*order_by)
    ordered.withColumn("_place", F.monotonically_increasing_id()).drop(*drop).write.option(
        "compression", "zstd"
    ).parquet(path)
    reader = _file_per_task(spark) if tasks else spark
    return reader.read.schema(f"{df.drop(*drop).schema.toDDL()}, _place bigint").parquet(path).withColumns(
        {
            "_part": F.shiftright("_place", _POSITION_BITS),
            "_row": F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
        }
    )


def dense_key(
    df: DataFrame, order_by: list[str], key: str, drop: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """Number the rows 1..n in the stated order.

    ``order_by`` must be a total order over stable columns (for identical rows: the row's place
    in its source file), so that a repeated task puts each row where it was before. The rows are
    range-sorted over all tasks and written once with their place; the number of rows before each
    partition (one row per partition, so the broadcast is bounded by the task count) then turns
    places into numbers. Equal values of the first columns may spread over many tasks. Columns of ``drop`` serve
    the order only and are not stored; ``tasks`` is that of ``place_rows``.
    """
    placed = place_rows(df, order_by, key, drop, tasks)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return placed.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_row") + 1).alias(key), *df.drop(*drop).columns
    )
