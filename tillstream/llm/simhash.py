"""Near duplicates by SimHash, with an exact tiled comparison of all fingerprints.

Fingerprints lie in cells by the population counts of their two halves. Two fingerprints that differ
in at most ``radius`` bits lie in cells whose counts differ by at most ``radius`` in sum, so only
such cells meet; a cell's fingerprints are dealt into tiles of bounded size, and pairs of tiles are
dealt over all tasks, which compare them with exclusive-or and bit counts. Inside a pair of tiles the counts of the
four quarters rule out most of the remaining pairs in the same way. No bucket is capped and nothing
is approximate: every pair is either compared or ruled out by its counts.

A pair of tiles returns a spanning forest of the links it found, so a group of thousands of near
copies gives rows in proportion to its members. Components are found by star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.common import rows_that_stay, text_key
from tillstream.llm.components import components
from tillstream.session import written

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
# Fingerprints per tile: 0.5 MB. A task holds a pair of tiles.
TILE = 65_536
# Tiles of a cell that travel together; a key of the comparison is a pair of such chunks.
CHUNK = 4
# Comparisons of a task, before the counts of quarters rule most of them out, and the most tasks.
WORK = float(1 << 28)
MOST_TASKS = 20_000
# Numbers of one block of the comparison.
_BLOCK = 1 << 21


def fingerprint_of(raw: bytes, size: int = SHINGLE_WORDS) -> int:
    """Bit by bit the majority of the XXH64 of all shingles, repeats included; no words give zero."""
    import xxhash

    words = raw.lower().split()  # bytes: A-Z only, and white space is [\x20\x09-\x0D]
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    last = ends[size - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(plain[a:b], seed) for a, b in zip(first, last, strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fingerprint) per row; the fingerprint is a signed long of 64 bits."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of((t or "").encode(), size) for t in texts.to_pylist()], pa.int64())

    return docs.select("doc_id", text_key().alias("text_key"), F.arrow_udf(of, "long")("text").alias("fingerprint"))


def links_within(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within the radius, block by block.

    Both sides are sorted by the population counts of their quarters, so that each run of equal
    counts on the left meets only the runs on the right that its counts allow.
    """
    quarters = [np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16) for x in (left, right)]
    orders = [np.lexsort(q.T) for q in quarters]
    runs = []
    for q, order in zip(quarters, orders, strict=True):
        q = q[order]
        edge = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]).any(axis=1), [True])))
        runs.append((q[edge[:-1]], edge))
    (left_counts, left_edge), (right_counts, right_edge) = runs
    lengths = np.diff(right_edge)
    for run, counts in enumerate(left_counts):
        near = np.flatnonzero(np.abs(right_counts - counts).sum(axis=1) <= radius)
        if not len(near):
            continue
        mine = orders[0][left_edge[run] : left_edge[run + 1]]
        within = np.repeat(right_edge[near] - np.concatenate(([0], np.cumsum(lengths[near])[:-1])), lengths[near])
        theirs = orders[1][within + np.arange(len(within))]
        values = right[theirs]
        step = max(1, _BLOCK // len(values))
        for start in range(0, len(mine), step):
            rows = mine[start : start + step]
            i, j = np.nonzero(np.bitwise_count(left[rows, None] ^ values[None, :]) <= radius)
            yield rows[i], theirs[j]


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): each linked value but the least of its group with that least value.

    ``pairs`` holds places in ``values``. Labels sink to the smallest place of a group as the blocks
    arrive, so the pairs themselves are not kept.
    """
    order = np.argsort(values, kind="stable")
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.arange(len(values))
    parent = np.arange(len(values))
    for left, right in pairs:
        a, b = place[left], place[right]
        while len(a):
            a, b = parent[a], parent[b]
            open_pairs = a != b
            a, b = np.minimum(a, b)[open_pairs], np.maximum(a, b)[open_pairs]
            np.minimum.at(parent, b, a)
            while True:  # paths to their roots
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    child = np.flatnonzero(parent != np.arange(len(values)))
    ranked = values[order]
    low, high = ranked[parent[child]], ranked[child]
    real = low != high  # a value that lies on both sides is one node
    return low[real], high[real]


def _neighbours(radius: int) -> list[tuple[int, int]]:
    """Steps to the cells that a cell meets: itself and one of each two opposite steps."""
    steps = range(-radius, radius + 1)
    return [(a, b) for a in steps for b in steps if abs(a) + abs(b) <= radius and (a, b) >= (0, 0)]


def _cells(nodes: DataFrame, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The tiles (a, b, part, values), and the pairs of cells that meet (a, b, a2, b2, chunks, chunks2, work).

    A cell's tiles are told off in chunks of ``CHUNK``. There are 33 x 33 cells at most, so at most
    27,225 pairs of them.
    """
    cell = [
        F.bit_count(F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("a"),
        F.bit_count(F.shiftrightunsigned("fingerprint", 32)).alias("b"),
    ]
    placed = nodes.select("fingerprint", *cell)
    counts = written(
        placed.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", "n", F.ceil(F.col("n") / tile).alias("parts")),
        "cells",
    )
    dealt = placed.join(F.broadcast(counts), ["a", "b"]).withColumn(
        "part", F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    )
    tiles = written(
        dealt.groupBy("a", "b", "part").agg(F.collect_list("fingerprint").alias("values")), "tiles"
    )
    steps = F.array(*[F.struct(F.lit(a).alias("da"), F.lit(b).alias("db")) for a, b in _neighbours(radius)])
    chunks = F.ceil(F.col("parts") / CHUNK)
    mine = counts.select("a", "b", "n", chunks.alias("chunks"), F.explode(steps).alias("step"))
    theirs = counts.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"), chunks.alias("chunks2"))
    meet = mine.withColumns({"a2": F.col("a") + F.col("step.da"), "b2": F.col("b") + F.col("step.db")})
    return tiles, meet.join(F.broadcast(theirs), ["a2", "b2"]).select(
        "a", "b", "a2", "b2", "chunks", "chunks2", (F.col("n").cast("double") * F.col("n2")).alias("work")
    )


def tile_pairs(nodes: DataFrame, radius: int, tile: int, work: float = WORK) -> DataFrame:
    """(mine, theirs): the pairs of tiles to compare, dealt over tasks by number and not by cell.

    Each tile is sent to the chunks that it meets; a pair of chunks is a key of at most ``CHUNK`` x
    ``CHUNK`` pairs of tiles, so the fullest cells spread over as many tasks as they have such keys.
    The number of tasks follows the comparisons to make, which bytes say nothing about.
    """
    tiles, meet = _cells(nodes, radius, tile)
    meet = written(meet, "meet")
    total = meet.agg(F.sum("work")).first()[0] or 0.0
    tasks = int(min(max(1, -(-total // work)), MOST_TASKS))
    same = (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))
    wanted = ~same | (F.col("chunk") <= F.col("chunk2"))
    key = ["a", "b", "a2", "b2", "chunk", "chunk2"]

    def told_off(side: tuple[str, str], own: str, other: str, others: str, values: str) -> DataFrame:
        rows = tiles.select(F.col("a").alias(side[0]), F.col("b").alias(side[1]), "part", F.col("values").alias(values))
        return (
            rows.join(F.broadcast(meet), list(side))
            .withColumn(own, F.floor(F.col("part") / CHUNK))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
            .where(wanted).select(*key, F.col("part").alias(f"{values}_part"), values)
            .repartition(tasks, *key)
        )

    left = told_off(("a", "b"), "chunk", "chunk2", "chunks2", "mine")
    right = told_off(("a2", "b2"), "chunk2", "chunk", "chunks", "theirs")
    return left.join(right, key).where(~same | (F.col("mine_part") <= F.col("theirs_part"))).select("mine", "theirs")


def linked(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(low, high): links between distinct fingerprints that join the same groups as all links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, theirs in zip(batch.column(0), batch.column(1), strict=True):
                left_values = np.asarray(mine.values, dtype=np.int64)
                right_values = np.asarray(theirs.values, dtype=np.int64)
                shift = len(left_values)
                found = (
                    (i, j + shift)
                    for i, j in links_within(left_values.view("<u8"), right_values.view("<u8"), radius)
                )
                low, high = forest(found, np.concatenate((left_values, right_values)))
                if len(low):
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["low", "high"])

    return tile_pairs(nodes, radius, tile).mapInArrow(compare, "low long, high long")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, component), one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits,
    ``component`` the smallest fingerprint. Null, empty and wordless texts have fingerprint zero and
    are linked like any other. Repeated rows share their component; a null id is never the smallest
    unless its component has no other. Other columns are not read; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, size), "fingerprints")
    nodes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "nodes")
    groups = written(components(linked(nodes, radius, tile)), "components")
    named = nodes.join(groups, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", F.coalesce("component", "fingerprint").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    members = named.join(least, "component").select("fingerprint", "component", "component_id")
    return rows.join(members, "fingerprint").select(
        "doc_id", "text_key", "fingerprint", "component_id", "component"
    )


def drop_near_duplicates(
    docs: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: its smallest id, then smallest key."""
    found = written(near_duplicates(docs, size, radius, tile), "near")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = first.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    chosen = keys.groupBy("component").agg(F.min("text_key").alias("chosen_key"))
    stay = keys.join(chosen, "component").where(F.col("text_key").eqNullSafe(F.col("chosen_key")))
    return rows_that_stay(docs, stay)
