"""Load and open the stored star schema."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream import schemas
from tillstream.operators import star
from tillstream.operators.star import Star
from tillstream.session import scratch_freed


def _store(df: DataFrame, path: str, by_month: bool = False) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
    (writer.partitionBy("sale_month") if by_month else writer).parquet(path)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.WAREHOUSE[name]).parquet(f"{path}/{name}")


def load_warehouse(sales: DataFrame, regions: DataFrame, path: str) -> Star:
    """Full refresh of the six tables under ``path``; returns them as stored.

    Do not run it on a folder that others read: load a new one and hand over its name. Scratch data
    is deleted once the tables are stored.
    """
    with scratch_freed(sales.sparkSession):
        _load(sales, regions, path)
    return open_warehouse(sales.sparkSession, path)


def _load(sales: DataFrame, regions: DataFrame, path: str) -> None:
    spark = sales.sparkSession

    def dimension(name: str, built: DataFrame, columns: list[str]) -> DataFrame:
        _store(built.select(*columns), f"{path}/{name}")
        return built

    # The dimensions do not depend on each other; their jobs share the cluster.
    with ThreadPoolExecutor(4) as pool:
        dates = pool.submit(lambda: _store(star.build_dim_date(sales), f"{path}/dim_date"))
        products = pool.submit(
            lambda: dimension("dim_product", star.build_dim_product(sales), star.DIM_PRODUCT)
        )
        customers = pool.submit(
            lambda: dimension("dim_customer", star.build_dim_customer(sales), star.DIM_CUSTOMER)
        )
        countries = pool.submit(
            lambda: dimension(
                "dim_geography", star.build_dim_geography(sales, regions), star.DIM_GEOGRAPHY
            )
        )
        dates.result()
        product, customer, geography = products.result(), customers.result(), countries.result()

    fact = star.build_fact_sales(sales, product, customer, geography)
    _store(
        star.with_sale_month(fact).sortWithinPartitions("sale_month", "sale_id"), f"{path}/fact_sales", by_month=True
    )

    daily = star.build_agg_daily_by_month(_read(spark, path, "fact_sales"))
    _store(daily.sortWithinPartitions("sale_month", "date_key"), f"{path}/agg_daily_sales", by_month=True)


def open_warehouse(spark: SparkSession, path: str) -> Star:
    return Star(**{name: _read(spark, path, name) for name in schemas.WAREHOUSE})


def table_counts(warehouse: Star) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.count("*").alias("num_rows")).select(F.lit(name).alias("table_name"), "num_rows")
        for name, df in warehouse.tables().items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result
