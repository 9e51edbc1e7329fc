"""Country to region lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_REGION = "Other"

# The regions that sales reports group countries into.
REGION_OF_COUNTRY = {
    "United Kingdom": "Europe", "Germany": "Europe", "France": "Europe",
    "Netherlands": "Europe", "Belgium": "Europe", "Switzerland": "Europe",
    "Spain": "Europe", "Portugal": "Europe", "Italy": "Europe",
    "Denmark": "Europe", "Finland": "Europe", "Norway": "Europe",
    "Sweden": "Europe", "Poland": "Europe", "Austria": "Europe",
    "Cyprus": "Europe", "Greece": "Europe", "Malta": "Europe",
    "Australia": "Asia-Pacific", "Japan": "Asia-Pacific",
    "Singapore": "Asia-Pacific", "Bahrain": "Asia-Pacific",
    "USA": "Americas", "Canada": "Americas", "Brazil": "Americas",
    "EIRE": "Europe", "Channel Islands": "Europe",
}


def region_table(spark: SparkSession) -> DataFrame:
    """The fixed lookup as a (country, region) table of 27 rows."""
    return spark.createDataFrame(sorted(REGION_OF_COUNTRY.items()), "country string, region string")


def with_region(countries: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add ``region`` to rows that have ``country``.

    The lookup has one row per country; Catalyst broadcasts it while it is below the session's
    size limit and shuffles it beyond.
    """
    return countries.join(lookup.select("country", "region"), "country", "left").withColumn(
        "region", F.coalesce("region", F.lit(DEFAULT_REGION))
    )
