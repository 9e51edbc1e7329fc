"""Near-duplicate embeddings by lattice hashing.

1. Equal vectors are one class, grouped by a digest; each class is compared once and counts for all its rows.
2. A table projects unit vectors to ``BLOCKS`` times eight dimensions, moves them by a random shift and
   decodes each eight to the nearest point of the lattice E8. A class lies in its own cell of each table
   and probes the ``PROBES`` neighbouring cells that are nearest to it.
3. Cells are counted by slim rows first. Of cells in which nothing meets nothing more is made; cells
   with more than ``TILE`` members are dealt into pairs of tiles. Only then vectors join their cells.
4. A task compares the members of a cell, or of a pair of tiles, by their cosine in double precision. A pair
   that meets several times counts at its first meeting, which both members' cells tell. A task
   returns a number of links for each member and a spanning forest of its links, so a group of thousands of
   near copies gives rows in proportion to its members.
5. Components are found by star contractions over classes.

Vectors with a cosine of 0.9 meet in one of the default's four tables with a probability of about 0.97, those
of 0.95 with 0.999, those of 0.98 with 0.99999. Pairs that meet are verified, so no link is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.common import join_by_group
from tillstream.llm.components import components
from tillstream.session import written

LEAST_COSINE = 0.9
TABLES = 4
# Lattice points that make a cell's name: more of them make smaller cells, for more vectors.
BLOCKS = 2
# Length of a projected unit vector's coordinates against the lattice, whose points are 1.41 apart.
SCALE = 0.4
PROBES = 8
SEED = 13
# Members of a cell that meet in one task; more are dealt into tiles.
TILE = 2048

# Pairs of one block of the comparison.
_PAIRS = 1 << 21


def shortest_vectors() -> np.ndarray:
    """The 240 steps from a point of E8 to its neighbours."""
    rows = []
    for places in combinations(range(8), 2):
        for signs in product((1.0, -1.0), repeat=2):
            row = np.zeros(8)
            row[list(places)] = signs
            rows.append(row)
    rows += [np.array(row) for row in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in row) % 2 == 0]
    return np.stack(rows)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: whole numbers with an even sum."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[rows]).argmax(axis=1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest_points(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 moved by a half."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Lattice:
    """Cells of vectors of one length. All numbers follow from the seed and the length."""

    def __init__(self, length: int, tables: int, blocks: int, scale: float, probes: int):
        random = np.random.default_rng([SEED, length])
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.project = random.normal(size=(tables, blocks, length, 8)) * scale
        self.shift = random.uniform(0, 2, size=(tables, blocks, 8))
        # A cell's name is a sum over twice its coordinates, so that a step changes it by the step's own sum.
        self.factors = random.integers(1, 1 << 62, size=(tables, blocks, 8)) * 2 + 1
        self.start = random.integers(0, 1 << 62, size=tables)
        self.steps = shortest_vectors()
        self.step_names = np.einsum("sk,tbk->tbs", (2 * self.steps).astype(np.int64), self.factors)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """For each vector and table the name of its own cell and of the cells that it probes."""
        return np.concatenate([self._cells_of_table(unit, t) for t in range(self.tables)], axis=1)

    def _cells_of_table(self, unit: np.ndarray, t: int) -> np.ndarray:
        rows = np.arange(len(unit))[:, None]
        own = np.full(len(unit), self.start[t], dtype=np.int64)
        # Squared distance that a choice of steps adds, and by how much it changes the name; the first is no step.
        cost, change = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), dtype=np.int64)
        for b in range(self.blocks):
            x = unit @ self.project[t, b] + self.shift[t, b]
            point = nearest_points(x)
            own += (2 * point).astype(np.int64) @ self.factors[t, b]
            farther = 2 - 2 * ((x - point) @ self.steps.T)
            near = np.argpartition(farther, self.probes, axis=1)[:, : self.probes]
            block_cost = np.concatenate((np.zeros((len(unit), 1)), farther[rows, near]), axis=1)
            block_change = np.concatenate((np.zeros((len(unit), 1), dtype=np.int64), self.step_names[t, b][near]), axis=1)
            cost = (cost[:, :, None] + block_cost[:, None, :]).reshape(len(unit), -1)
            change = (change[:, :, None] + block_change[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(cost[:, 1:], axis=1, kind="stable")[:, : self.probes] + 1
        return np.concatenate((own[:, None], own[:, None] + change[rows, order]), axis=1)


def unit_vectors(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length one in double precision."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _compared(vector: str):
    """Whether a vector can link: no null or non-finite component, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def classes(vectors: DataFrame) -> DataFrame:
    """(node, digest, least_id, size, vector) of the distinct vectors that can link; stored."""
    found = vectors.where("compared").groupBy("digest").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("size"), F.first("embedding").alias("vector")
    )
    # Stored once, so the numbers stay what they are.
    return written(found.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")


def with_cells(nodes: DataFrame, tables: int, blocks: int, scale: float, probes: int) -> DataFrame:
    """Nodes with ``cells``: for each table the own cell and the probed ones; stored."""

    def name_cells(vectors: pa.Array) -> pa.Array:
        lengths = np.asarray(vectors.value_lengths())
        out = np.zeros((len(vectors), tables * (1 + probes)), dtype=np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            lattice = Lattice(int(length), tables, blocks, scale, probes)
            out[rows] = lattice.cells(unit_vectors(vectors.take(pa.array(rows))))
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.int64()))

    return written(nodes.withColumn("cells", F.arrow_udf(name_cells, "array<bigint>")("vector")), "cells")


def meetings(signed: DataFrame, per_table: int, tile: int) -> DataFrame:
    """(cell, left_tile, right_tile, node, is_left, is_right): who meets in which task.

    Right are the classes whose own cell it is, left all that look into it. A cell in which no two
    classes meet is left out.
    """
    placed = signed.select("node", F.posexplode("cells").alias("at", "cell")).select(
        "node", "cell", (F.col("at") % per_table == 0).alias("own")
    )
    counted = placed.groupBy("cell").agg(F.count_if("own").alias("right"), F.count("*").alias("size")).where(
        (F.col("right") > 0) & (F.col("size") > 1)
    ).select(
        "cell", "size",
        F.ceil(F.col("size") / tile).cast("int").alias("left_tiles"), F.ceil(F.col("right") / tile).cast("int").alias("right_tiles"),
    )
    dealt = join_by_group(placed, written(counted, "cell-counts"), "cell", "size").withColumns(
        {
            "left_tile": F.pmod(F.xxhash64("node"), F.col("left_tiles")).cast("int"),
            "right_tile": F.pmod(F.xxhash64("node", F.lit(1)), F.col("right_tiles")).cast("int"),
        }
    )
    small = (F.col("left_tiles") == 1) & (F.col("right_tiles") == 1)
    zero = F.lit(0)
    # In a cell of one task a class is one row, left and right in one.
    at_once = dealt.where(small).select("cell", zero.alias("left_tile"), zero.alias("right_tile"), "node", F.lit(True).alias("is_left"), F.col("own").alias("is_right"))
    large = dealt.where(~small)
    left = large.select(
        "cell", "left_tile", F.explode(F.sequence(zero, F.col("right_tiles") - 1)).alias("right_tile"),
        "node", F.lit(True).alias("is_left"), F.lit(False).alias("is_right"),
    )
    right = large.where("own").select(
        "cell", F.explode(F.sequence(zero, F.col("left_tiles") - 1)).alias("left_tile"), "right_tile",
        "node", F.lit(False).alias("is_left"), F.lit(True).alias("is_right"),
    )
    return at_once.unionByName(left).unionByName(right)


def first_meetings(
    cell: int, left: np.ndarray, right: np.ndarray, left_cells: np.ndarray, right_cells: np.ndarray
) -> np.ndarray:
    """Of pairs found in a cell, which the left one looks into and the right one lies in, those that met nowhere
    before. Cells are arrays of pairs by tables by the own and the probed cells."""
    own_left, own_right = left_cells[:, :, 0], right_cells[:, :, 0]
    table = (own_right == cell).argmax(axis=1)
    into_right = (left_cells == own_right[:, :, None]).any(axis=2)
    into_left = (right_cells == own_left[:, :, None]).any(axis=2)
    earlier = np.arange(own_left.shape[1])[None, :] < table[:, None]
    before = ((into_right | into_left) & earlier).any(axis=1)
    # In the same table both may look at each other: the smaller one's look counts.
    both = into_left[np.arange(len(table)), table]
    return ~before & (~both | (left < right))


class Links:
    """Links of one task's cells: how many each member has, and which members they join."""

    def __init__(self, tables: int, least: float):
        self.tables, self.least = tables, least

    def of(self, cell: int, rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, joined, links) for the members of one meeting: each node with the least one of its group."""
        is_left, is_right = (np.asarray(rows.field(name)) for name in ("is_left", "is_right"))
        lengths = np.asarray(rows.field("vector").value_lengths())
        sizes = np.asarray(rows.field("size"))
        order = np.argsort(np.asarray(rows.field("node")), kind="stable")
        nodes = np.asarray(rows.field("node"))[order]
        known = np.unique(nodes)
        parent, links = np.arange(len(known)), np.zeros(len(known), dtype=np.int64)
        for length in np.unique(lengths):
            mine = np.flatnonzero((lengths == length) & is_left)
            theirs = np.flatnonzero((lengths == length) & is_right)
            if not len(mine) or not len(theirs):
                continue
            self._compare(cell, rows, mine, theirs, known, sizes, parent, links)
        while True:  # paths to their roots
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        return known, known[parent], links

    def _compare(self, cell, rows, mine, theirs, known, sizes, parent, links) -> None:
        def side(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            part = rows.take(pa.array(places))
            cells = np.asarray(part.field("cells").flatten()).reshape(len(places), self.tables, -1)
            return np.asarray(part.field("node")), unit_vectors(part.field("vector")), cells, sizes[places]

        left, left_units, left_cells, left_sizes = side(mine)
        right, right_units, right_cells, right_sizes = side(theirs)
        left_at, right_at = np.searchsorted(known, left), np.searchsorted(known, right)
        step = max(1, _PAIRS // len(right))
        for start in range(0, len(left), step):
            i, j = np.nonzero(left_units[start : start + step] @ right_units.T >= self.least)
            i += start
            for part in range(0, len(i), _PAIRS // 16):
                a, b = i[part : part + _PAIRS // 16], j[part : part + _PAIRS // 16]
                different = left[a] != right[b]
                a, b = a[different], b[different]
                first = first_meetings(cell, left[a], right[b], left_cells[a], right_cells[b])
                a, b = a[first], b[first]
                np.add.at(links, left_at[a], right_sizes[b])
                np.add.at(links, right_at[b], left_sizes[a])
                _sink(parent, left_at[a], right_at[b])


def _sink(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Labels sink to the smallest place of a group."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(parent, b, a)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def found_links(signed: DataFrame, met: DataFrame, tables: int, least: float) -> DataFrame:
    """(node, joined, links) for each member of each meeting that has links there; stored."""
    members = met.join(signed, "node")
    meeting = members.groupBy("cell", "left_tile", "right_tile").agg(
        F.collect_list(F.struct("node", "size", "vector", "cells", "is_left", "is_right")).alias("members")
    ).where(F.size("members") > 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compared = Links(tables, least)
        for batch in batches:
            parts = []
            for cell, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                node, joined, links = compared.of(cell, rows.values)
                linked = (links > 0) | (node != joined)
                if linked.any():
                    parts.append((node[linked], joined[linked], links[linked]))
            if parts:
                columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "joined", "links"])

    return written(
        meeting.select("cell", "members").mapInArrow(compare, "node long, joined long, links long"), "links"
    )


def near_duplicates(
    embeddings: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, blocks: int = BLOCKS,
    scale: float = SCALE, probes: int = PROBES, tile: int = TILE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``embeddings``.

    ``n_links`` counts the other rows whose cosine with this one is at least ``least``, equal vectors
    included; ``component_id`` is the smallest id reachable over links. A vector that is null, empty, zero or has
    a null or non-finite component links with nothing and is its own component; vectors of different
    lengths never link. Rows of one id are rows of their own. A row without an id counts like any other and is
    never the smallest unless its component has no id; then the component is null, and such rows are all kept. Only
    ``vec_id`` and ``embedding`` are read, so other columns cannot clash; an empty table gives no rows.
    """
    vectors = embeddings.select("vec_id", "embedding").withColumns(
        {"compared": _compared("embedding"), "digest": F.unhex(F.md5(F.col("embedding").cast("string")))}
    )
    signed = with_cells(classes(vectors), tables, blocks, scale, probes)
    links = found_links(signed, meetings(signed, 1 + probes, tile), tables, least)
    joined = links.where(F.col("node") != F.col("joined"))
    groups = components(joined.select(F.col("joined").alias("low"), F.col("node").alias("high")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        signed.select("node", "digest", "least_id", "size").join(counts, "node", "left").join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least_ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    members = written(
        named.join(least_ids, "component").select(
            "digest", "size", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
        ),
        "members",
    )
    settled = join_by_group(vectors.where("compared").select("vec_id", "digest"), members, "digest", "size")
    alone = vectors.where("NOT compared").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return settled.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
