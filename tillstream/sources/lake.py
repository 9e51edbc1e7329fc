"""Raw transaction files to a cleaned Parquet lake partitioned by Year and Month."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tillstream import schemas
from tillstream.operators.clean import clean_sales

# One column more than the file has. It is filled only by lines with too many fields.
_SURPLUS = "_surplus"
# The text of a line that does not fit, and the number of fields of one that does.
_LINE, _FIELDS = "_line", 8


def _reader(spark: SparkSession, header: bool, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", header)
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .option("multiLine", multi_line)
    )


def read_sales_csv(spark: SparkSession, path: str, header: bool = True, multi_line: bool = False) -> DataFrame:
    """Typed raw rows of one file or folder.

    Lines with too many fields are skipped; lines with too few are kept, the missing fields null.
    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    """
    rows = _reader(spark, header, multi_line).schema(f"{schemas.RAW_SALES}, {_SURPLUS} string").csv(path)
    return rows.where(F.col(_SURPLUS).isNull()).drop(_SURPLUS)


def rejected_lines(spark: SparkSession, path: str, header: bool = True, multi_line: bool = False) -> DataFrame:
    """(source_file, line, reason, kept): the lines that do not fit the schema, as they stand in the file.

    ``kept`` is false for lines with too many fields, which ``read_sales_csv`` skips, and true for those
    that it reads with nulls: a value that cannot be read, or too few fields. A line with several faults
    has the first of these reasons. Blank lines are no lines.
    """
    rows = (
        _reader(spark, header, multi_line)
        .schema(f"{schemas.RAW_SALES}, {_LINE} string")
        .option("columnNameOfCorruptRecord", _LINE)
        .option("columnPruning", False)  # a pruned line would not be held against the schema
        .csv(path)
        # Spark reads no line for its text alone, hence a condition on a field that always holds.
        .where(F.col(_LINE).isNotNull() & (F.coalesce(F.length("Invoice"), F.lit(0)) >= 0))
    )
    names = [f"_{i}" for i in range(_FIELDS + 1)]
    fields = F.from_csv(_LINE, ", ".join(f"{n} string" for n in names), {"escape": '"'})
    unreadable = [
        F.col(f"_fields._{place}").isNotNull() & F.col(name).isNull()
        for place, name in ((3, "Quantity"), (4, "InvoiceDate"), (5, "Price"))
    ]
    too_many = F.col(f"_fields._{_FIELDS}").isNotNull()
    return rows.withColumn("_fields", fields).select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col(_LINE).alias("line"),
        F.when(too_many, "too many fields")
        .when(unreadable[0] | unreadable[1] | unreadable[2], "unreadable value")
        .otherwise("too few fields")
        .alias("reason"),
        (~too_many).alias("kept"),
    )


def write_lake(sales: DataFrame, path: str) -> None:
    """Replace only the (Year, Month) partitions that ``sales`` holds; a rerun is idempotent.

    Rebalancing brings a month to few tasks, hence few files, and at run time splits a month that
    holds much of the data over several. Unlike a range partitioning it needs no sample, which
    would parse the raw files twice. Sorting by time lets a day filter skip row groups.
    """
    (
        sales.hint("rebalance", "Year", "Month")
        .sortWithinPartitions("Year", "Month", "InvoiceDate")
        .write.partitionBy("Year", "Month")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_lake(spark: SparkSession, path: str, with_row_id: bool = False) -> DataFrame:
    """All partitions of the lake.

    ``with_row_id`` adds the file and the row's place in it. That pair names a row once and for
    all, so it breaks ties between identical rows the same way in every task attempt.
    """
    rows = spark.read.schema(schemas.CLEAN_SALES).parquet(path)
    if not with_row_id:
        return rows
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.row_index").alias("source_row"),
    )


def lake_summary(lake: DataFrame) -> DataFrame:
    """Rows and months per year."""
    return lake.groupBy(F.col("Year").alias("year")).agg(
        F.count("*").alias("num_rows"), F.count_distinct("Month").alias("num_months")
    )


def ingest(spark: SparkSession, csv_path: str, lake_path: str, rejects_path: str | None = None) -> DataFrame:
    """Read, clean and store; returns the stored lake. Lines that do not fit the schema are also written
    to ``rejects_path``, where one is named."""
    if rejects_path:
        rejected_lines(spark, csv_path).write.mode("overwrite").parquet(rejects_path)
    write_lake(clean_sales(read_sales_csv(spark, csv_path)), lake_path)
    return read_lake(spark, lake_path)
