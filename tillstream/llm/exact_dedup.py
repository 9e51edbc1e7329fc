"""Exact duplicates with a split for heavy hitters, in DataFrame operations only.

1. Every text is reduced to the SHA-256 of its normalised form; these slim rows are stored once.
2. A frequent-items sketch per task, a mergeable form of the Misra-Gries counters, proposes digests
   that may hold a large share of the rows. Its counters are few, whatever the input.
3. The proposed digests are counted exactly. Those that hold more than one row in ``HEAVY_SHARE``
   are verified: there are at most that many, so their winners are broadcast, and all their rows are
   decided where they lie.
4. The other digests, none of which has a large group, are shuffled and decided in windows.

Which digests the sketch proposes changes the path of a row, never its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstream.llm.common import rows_that_stay, text_key
from tillstream.session import written

# A digest with more than one of so many rows is heavy: at most so many winners are broadcast.
HEAVY_SHARE = 1024
# Counters of a sketch: its counts are wrong by at most 3.5 rows in so many.
COUNTERS = 8192
# Sketches of the tasks are merged in so many tasks before the last one.
MERGERS = 32


def normalised(text: Column) -> Column:
    r"""The text without the characters ``[\x20\x09-\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars, text_key, row_id) per row; ``row_id`` tells repeated rows apart."""
    return docs.select(
        "doc_id",
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"),
        text_key().alias("text_key"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def proposed_heavy(rows: DataFrame) -> DataFrame:
    """(item): hashes of at most ``HEAVY_SHARE`` digests that may be heavy."""
    per_task = rows.select(
        F.xxhash64("digest").alias("item"), (F.spark_partition_id() % MERGERS).alias("merger")
    ).groupBy("merger").agg(F.expr(f"approx_top_k_accumulate(item, {COUNTERS})").alias("sketch"))
    # Merged under a key, the same for all: without one, a task without rows hands on a sketch of no
    # type, which Spark cannot merge.
    one = F.floor(F.col("merger") / MERGERS)
    sketch = per_task.groupBy(one.alias("one")).agg(
        F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch")
    )
    top = F.expr(f"approx_top_k_estimate(sketch, {HEAVY_SHARE})")
    return sketch.select(F.explode(top).alias("top")).select("top.item")


def _order() -> Column:
    """Smallest for the row that stays: most code points, then smallest id (null last), then one of equals."""
    return F.struct(
        (-F.col("n_chars")).alias("length"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"
    )


def heavy_winners(rows: DataFrame) -> DataFrame:
    """(heavy_digest, keep_id, keep_row, group_size) of the digests verified to be heavy."""
    found = rows.join(F.broadcast(proposed_heavy(rows)), F.xxhash64("digest") == F.col("item"), "left_semi")
    groups = found.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(_order()).alias("first"))
    total = rows.agg(F.count("*").alias("total"))
    return groups.join(F.broadcast(total)).where(
        (F.col("group_size") > 1) & (F.col("group_size") * HEAVY_SHARE > F.col("total"))
    ).select(
        F.col("digest").alias("heavy_digest"), F.col("first.doc_id").alias("keep_id"),
        F.col("first.row_id").alias("keep_row"), "group_size",
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, text_key), one row per row of ``docs``.

    Of texts that are equal after normalisation one row stays: the longest original, then the
    smallest id; a null id comes last; of the same row repeated, exactly one. Null and empty texts
    are one group. Only ``doc_id`` and ``text`` are read, so other columns cannot clash; an empty
    table gives no rows.
    """
    rows = written(digests(docs), "digests")
    winners = F.broadcast(written(heavy_winners(rows), "heavy"))

    settled = rows.join(winners, F.col("digest") == F.col("heavy_digest"))
    settled = settled.withColumn("kept", F.col("row_id") == F.col("keep_row"))

    group = Window.partitionBy("digest")
    ranked = group.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"), "row_id")
    light = rows.join(winners, F.col("digest") == F.col("heavy_digest"), "left_anti").select(
        "*",
        F.first("doc_id").over(ranked).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest", "text_key"]
    return settled.select(columns).unionByName(light.select(columns))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    decided = written(exact_duplicates(docs), "decided")
    copies = decided.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("copies"), F.max("kept").alias("kept")
    )
    return rows_that_stay(docs, copies.where("kept"))
