"""Shards that all hold the mixture of sources: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked inside their source; a rank, plus the source's own seeded
part of one, becomes a fraction of its source's rows, all rows are put in the order of their fractions, and that order is cut into equal
runs. Every stretch of it holds the sources in proportion, so every shard does.

Both orders are range sorts of slim rows over all tasks, numbered by the counts of their partitions,
so neither a source with a third of all rows nor the last sort lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.common import text_key
from tillstream.operators.keys import dense_key
from tillstream.session import written

SHARDS = 16
SEED = 17
LAW = "rows"


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, text_key, shard, slot), one row per row of ``docs``.

    Shards differ by at most one row; slots count from 0. ``size`` is the text's UTF-8 bytes plus one.
    A null text counts as empty and a null source as the empty name; rows repeated in full are
    interchangeable and get a place each. Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key().alias("text_key"),
    ).withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "text_key"))
    total_order = ["shuffled", "doc_id", "text_key", "size", "text_crc32"]

    inside = written(dense_key(slim, ["source", *total_order], "number"), "ranked")
    sources = inside.groupBy("source").agg(F.count("*").alias("rows"), F.min("number").alias("first"))
    # Each source starts at a place of its own, or all sources of one row would meet in the middle.
    begin = (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    fraction = (F.col("number") - F.col("first") + begin) / F.col("rows")
    spread = inside.join(sources, "source").withColumn("fraction", fraction).drop("rows", "first", "number")
    placed = dense_key(spread, ["fraction", "source", *total_order], "number")

    total = inside.agg(F.count("*").alias("rows"))  # one row
    return (
        placed.join(F.broadcast(total))
        .withColumn("shard", F.expr(f"CAST((number - 1) * {shards} DIV rows AS INT)"))
        .withColumn("slot", F.expr(f"number - 1 - (shard * rows + {shards - 1}) DIV {shards}"))
        .select("doc_id", "source", "size", "text_crc32", "text_key", "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write ``docs`` under ``path``, a folder ``shard_no=`` per shard with rows in slot order.

    Returns the assignment. The written rows have the columns of ``docs`` in ``doc`` and their slot.
    """
    placed = written(stratified_shards(docs, shards, seed), "shards")
    places = placed.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("shard", "slot")).alias("places")  # one entry per copy of the same row
    )
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("key_id"), text_key().alias("key_text"))
    same = F.col("key_id").eqNullSafe(F.col("doc_id")) & (F.col("key_text") == F.col("text_key"))

    def joined(wanted: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(wanted.hint("shuffle_hash"), same).select("doc", F.explode("places").alias("place"))

    once, more = places.where(F.size("places") == 1), places.where(F.size("places") > 1)
    rows = joined(once, keyed)
    if not more.isEmpty():
        repeated = joined(more, keyed.join(more, same, "left_semi").dropDuplicates(["key_id", "key_text"]))
        rows = rows.unionByName(repeated)
    (
        rows.select("doc", F.col("place.slot").alias("slot"), F.col("place.shard").alias("shard_no"))
        .repartitionByRange("shard_no", "slot").sortWithinPartitions("shard_no", "slot")
        .write.partitionBy("shard_no").parquet(path)
    )
    return placed
