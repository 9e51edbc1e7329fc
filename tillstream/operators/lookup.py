"""Key lookup that stays balanced when a few keys hold much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot from this share of all rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 256
_SALTS = 4096
# Members up to which a whole dimension is broadcast, some 30 MB.
MOST_BROADCAST = 250_000


def lookup_key(
    rows: DataFrame, dim: DataFrame, on: str, key: str, weight: str, num_rows: int
) -> DataFrame:
    """Left join ``dim[key]`` to ``rows`` by the column ``on``.

    A dimension of at most ``MOST_BROADCAST`` members is broadcast whole, and no row is shuffled. Of a larger one,
    ``weight`` is the number of rows that each dim member has, ``num_rows`` that of all. The hot members (at most 256 by
    definition) are broadcast; the others are joined as Catalyst sees fit. Rows that found their
    key in the hot table, and rows without a value, enter that second join with a salted value
    that matches nothing, which spreads them over the tasks.
    """
    if dim.count() <= MOST_BROADCAST:
        known = dim.select(F.col(on).alias("_on"), F.col(key))
        return rows.join(F.broadcast(known), F.col(on) == F.col("_on"), "left").drop("_on")
    is_hot = F.col(weight) > num_rows * HOT_SHARE
    hot = dim.where(is_hot).select(F.col(on).alias("_hot_on"), F.col(key).alias("_hot_key"))
    rest = dim.where(~is_hot).select(
        F.col(on).alias("_rest_on"), F.col(key).alias("_rest_key")
    )
    salt = F.concat(
        F.lit("\u0000"), F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS)).cast("string")
    )
    settled = F.col("_hot_key").isNotNull() | F.col(on).isNull()
    return (
        rows.join(F.broadcast(hot), F.col(on) == F.col("_hot_on"), "left")
        .withColumn("_on", F.when(settled, salt).otherwise(F.col(on)))
        .join(rest, F.col("_on") == F.col("_rest_on"), "left")
        .withColumn(key, F.coalesce("_hot_key", "_rest_key"))
        .drop("_hot_on", "_hot_key", "_on", "_rest_on", "_rest_key")
    )
