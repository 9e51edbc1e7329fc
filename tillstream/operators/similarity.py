"""Nearest vectors by cosine: exactly, or through bucketed random projections.

For the exact join both sides are packed into rows of a few thousand vectors inside their partitions. The vector
packs are spread over buckets, every query pack goes to every bucket, and one equi-join on the
bucket lets each query pack meet each vector pack once. A matrix product in the task then keeps the
k best per query and pack, so no list of pairs ever exists. Its work is queries times vectors.

The projection join compares a query with the vectors that share a bucket with it in one of several
tables, so its work follows the buckets' sizes; what it misses is measured against the exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstream.session import written

# Numbers per pack: 16 MB as float64.
_PACK_NUMBERS = 2_000_000
# Similarities are compared at this many decimals, equal ones by id.
DECIMALS = 6


def _pack(rows: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """One row per few thousand vectors: their ids and their numbers in one flat array."""

    limit = _PACK_NUMBERS  # closures hold plain values, so that workers need no import of ours

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            size = max(1, limit // max(1, len(frame["v"].iloc[0])))
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size]
                numbers = np.concatenate(part["v"].to_list()).astype("float64")
                yield pd.DataFrame(
                    {f"{prefix}_ids": [part["id"].to_numpy()], f"{prefix}_numbers": [numbers]}
                )

    wanted = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(
        F.col("v").isNotNull()
    )
    return wanted.mapInPandas(pack, f"{prefix}_ids array<bigint>, {prefix}_numbers array<double>")


def top_k_similar(
    queries: DataFrame, vectors: DataFrame, k: int = 3, query_id: str = "query_id",
    query_vector: str = "vector", vector_id: str = "vec_id", vector: str = "vector",
    buckets: int | None = None,
) -> DataFrame:
    """(query_id, vec_id, similarity, place) of the k nearest vectors per query.

    A query pack is copied once per bucket; by default there are as many buckets as the vectors
    fill packs, at most one per task slot.
    """
    spark = queries.sparkSession
    if buckets is None:
        size = vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
        packs = -(-size["n"] * (size["dim"] or 1) // _PACK_NUMBERS)
        buckets = max(1, min(packs, spark.sparkContext.defaultParallelism))
    left = _pack(queries, query_id, query_vector, "q").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    )
    right = _pack(vectors, vector_id, vector, "v").withColumn(
        "bucket", F.pmod(F.xxhash64("v_ids"), F.lit(buckets)).cast("int")
    )

    decimals = DECIMALS

    def unit(numbers, rows: int) -> np.ndarray:
        matrix = np.asarray(numbers, dtype="float64").reshape(rows, -1)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, found = np.asarray(row.q_ids), np.asarray(row.v_ids)
                scores = np.round(
                    unit(row.q_numbers, len(ids)) @ unit(row.v_numbers, len(found)).T, decimals
                )
                best = np.lexsort((np.broadcast_to(found, scores.shape), -scores), axis=1)[:, :k]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(ids, best.shape[1]),
                        "vec_id": found[best].ravel(),
                        "similarity": np.take_along_axis(scores, best, axis=1).ravel(),
                    }
                )

    candidates = left.join(right, "bucket").drop("bucket").mapInPandas(
        nearest, "query_id bigint, vec_id bigint, similarity double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# Of two unit vectors at distance 1.05, a cosine of 0.45, two in three share a bucket of this width.
BUCKET_WIDTH = 2.5
PROJECTIONS = 6


# Vectors of a bucket that meet in one task.
_CELL_VECTORS = 20_000


def _whole_vectors(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(name, numbers): ids and vectors, stored; one that is null, zero or not finite is near nothing."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    wanted = rows.where(whole & F.exists(vector, lambda x: x != 0)).select(
        F.col(key).cast("long").alias(name), F.col(vector).alias("numbers")
    )
    # Stored, because Spark may otherwise run the vector functions before it has left rows out.
    return written(wanted, "vectors")


def _unit_vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with the vectors of length one as ``unit``."""
    raw = rows.withColumn("raw", array_to_vector(F.col("numbers").cast("array<double>")))
    return Normalizer(inputCol="raw", outputCol="unit").transform(raw).drop("raw")


def top_k_by_projections(
    queries: DataFrame, vectors: DataFrame, k: int = 3, query_id: str = "query_id",
    query_vector: str = "vector", vector_id: str = "vec_id", vector: str = "vector",
    width: float = BUCKET_WIDTH, tables: int = PROJECTIONS, least: float = -1.0, seed: int = 7,
) -> DataFrame:
    """(query_id, vec_id, similarity, place) of up to k near vectors per query with a similarity of at least ``least``.

    Vectors meet by table and bucket, a large bucket's in several cells; a task scores a cell's pairs exactly by a
    matrix product and hands on each query's k best, so pairs are never stored. Narrower
    buckets leave more pairs out, more tables bring more of them back: for neighbours at distance d choose
    a width of about 2 d. A query whose neighbours are all missed has fewer than k.
    """
    asked = _whole_vectors(queries, query_id, query_vector, "query_id")
    known = _whole_vectors(vectors, vector_id, vector, "vec_id")
    unit = _unit_vectors(known)
    hashing = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="buckets", bucketLength=width, numHashTables=tables, seed=seed
    ).fit(unit)
    parts = {"known_part": max(1, -(-known.count() // _CELL_VECTORS)), "asked_part": max(1, -(-asked.count() // _CELL_VECTORS))}

    def dealt(hashed: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """A row per table and part of the other side, with the bucket and the part of its own side."""
        found = hashing.transform(hashed).select(name, "numbers", F.posexplode("buckets").alias("table", "hashed"))
        return found.select(
            name, "numbers", "table", vector_to_array("hashed")[0].cast("long").alias("bucket"),
            F.pmod(F.xxhash64(name), F.lit(parts[own])).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1))).alias(other),
        )

    decimals, farthest = DECIMALS, float(np.sqrt(2 - 2 * least)) + 1e-9

    def scaled(numbers: pa.ChunkedArray, rows: int) -> np.ndarray:
        flat = numbers.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype("float64").reshape(rows, -1)
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            asked, known = scaled(left["numbers"], left.num_rows), scaled(right["numbers"], right.num_rows)
            coded = right["vec_id"].combine_chunks().dictionary_encode(null_encoding="encode")
            ids = np.empty(len(coded.dictionary), dtype="int64")  # ids in order, a null first
            ids[pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            of = ids[coded.indices.to_numpy(zero_copy_only=False)]
            repeats = len(ids) < len(of)
            for at in range(0, len(asked), 256):  # some 40 MB of scores at a time
                for row, score in enumerate(asked[at : at + 256] @ known.T, at):
                    near = np.flatnonzero(np.sqrt(np.maximum(2 - 2 * score, 0)) < farthest)
                    score = np.round(score[near], decimals)
                    if repeats:  # a vector that is there several times counts once
                        near = near[np.unique(np.stack([of[near], score]), axis=1, return_index=True)[1]]
                        score = np.round(asked[row] @ known[near].T, decimals)
                    if len(near) > k:
                        kept = score >= np.partition(score, -k)[-k]
                        near, score = near[kept], score[kept]
                    first = np.lexsort((of[near], -score))[:k]
                    rows += [row] * len(first)
                    found.append(near[first])
                    scores.append(score[first])
        whole = pa.array(np.concatenate(found) if found else [], pa.int64())
        return pa.table({
            "query_id": left["query_id"].take(pa.array(rows, pa.int64())), "vec_id": right["vec_id"].take(whole),
            "similarity": pa.array(np.concatenate(scores) if scores else [], pa.float64()),
        })

    cell = ["table", "bucket", "known_part", "asked_part"]
    near = dealt(_unit_vectors(asked), "query_id", "asked_part", "known_part").groupBy(*cell).cogroup(
        dealt(unit, "vec_id", "known_part", "asked_part").groupBy(*cell)
    ).applyInArrow(nearest, "query_id bigint, vec_id bigint, similarity double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the exact neighbours, and how many of them were found."""
    hits = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count("*").alias("neighbours"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
