"""Small hand-made inputs."""

from datetime import datetime

from pyspark.sql import functions as F

from tillstream import schemas
from tillstream.functions.regions import region_table
from tillstream.operators.clean import clean_sales
from tillstream.session import new_folder
from tillstream.sources.lake import read_lake, write_lake
from tillstream.sources.warehouse import load_warehouse


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def sale(invoice="1", code="A", description="thing", quantity=1.0, when="2020-01-01 10:00:00",
         price=5.0, customer="7", country="France"):
    return (invoice, code, description, float(quantity), at(when) if when else None, float(price),
            customer, country)


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_SALES)


def lake_of(spark, rows):
    path = new_folder(spark, "test-lake")
    write_lake(clean_sales(raw(spark, rows)), path)
    return read_lake(spark, path, with_row_id=True)


def star_of(spark, rows, regions=None):
    sales = lake_of(spark, rows)
    lookup = regions if regions is not None else region_table(spark)
    return load_warehouse(sales, lookup, new_folder(spark, "test-warehouse"))


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(df, condition, column):
    return df.where(condition).select(F.col(column)).first()[0]
