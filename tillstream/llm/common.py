"""What several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_of(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def text_key() -> Column:
    return F.xxhash64(F.col("text"))


def rows_that_stay(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_key) is in ``stay``, with all their own columns.

    ``stay`` holds (doc_id, text_key, copies), one row per key; of a key with several copies, which
    are the same row twice, one is returned. Only keys are hashed in memory, texts are not sorted.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("key_id"), text_key().alias("key_text"))
    wanted = written(stay.select("doc_id", "text_key", "copies"), "stay")

    def kept(keys: DataFrame) -> DataFrame:
        same = F.col("key_id").eqNullSafe(F.col("doc_id")) & (F.col("key_text") == F.col("text_key"))
        return keyed.join(keys.hint("shuffle_hash"), same, "left_semi")

    rows = kept(wanted.where(F.col("copies") == 1))
    repeated = wanted.where(F.col("copies") > 1)
    if not repeated.isEmpty():
        rows = rows.unionByName(kept(repeated).dropDuplicates(["key_id", "key_text"]))
    return rows.select("doc.*")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int, max_bytes: int
) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out share, of ``max_bytes`` in all.

    Labels meet the documents first, so labels of a larger corpus do not shrink the sample. The rows
    with the smallest hash of their id are taken, the same on every run, up to the first that would
    go beyond the bytes; a text longer than a hundredth of the bytes is left out. Of several labels of one id
    the highest counts.
    """
    marked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(share_of(F.col("doc_id"), parts) != held_out)
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    )
    sizes = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("key_id"), F.xxhash64("doc_id").alias("at"), text_key().alias("key_text"),
        F.octet_length("text").alias("size"),
    ).where(F.col("size") <= max_bytes // 100)
    # Rows repeated in full count once. At most ``rows`` slim rows are ordered in one task.
    met = sizes.join(marked, F.col("key_id") == F.col("label_id")).drop("label_id").distinct()
    first = met.orderBy("at", "key_id", "key_text").limit(rows)
    so_far = Window.orderBy("at", "key_id", "key_text").rowsBetween(Window.unboundedPreceding, 0)
    chosen = written(
        first.withColumn("bytes", F.sum("size").over(so_far)).where(F.col("bytes") <= max_bytes)
        .select("key_id", "key_text", "label"),
        "sample",
    )
    same = (F.col("doc_id") == F.col("key_id")) & (text_key() == F.col("key_text"))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), same)
    return found.dropDuplicates(["key_id", "key_text"]).orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label")


# A group with more than one of so many rows is heavy: at most so many are broadcast.
HEAVY_SHARE = 1024


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of their group; rows of no group are left out.

    ``groups`` is a stored table with a row per group: its ``key`` and the number of its rows, ``size``. Groups
    with more than one row in ``HEAVY_SHARE`` meet their rows by a broadcast, of at most so many groups;
    the others, none of them a hot key, as Spark decides.
    """
    total = groups.agg(F.sum(size)).scalar()
    heavy = F.col(size) * HEAVY_SHARE > total
    large = F.broadcast(written(groups.where(heavy), "heavy-groups"))
    light = rows.join(large, key, "left_anti").join(groups.where(~heavy), key)
    return rows.join(large, key).unionByName(light)
