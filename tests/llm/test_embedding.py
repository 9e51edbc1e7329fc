import numpy as np
import pytest

from checks.compare import connect, differences
from tests.llm import inputs
from tillstream.llm import embedding
from tillstream.llm.embedding import near_duplicates
from tillstream.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, node int, cell string, size int, component int, links int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "d", 1, "c", 2, 3, 4) for i, v in vectors], schema)


def unit(vector):
    values = None if vector is None or any(x is None for x in vector) else np.array(vector, dtype=np.float64)
    if values is None or not len(values) or not np.isfinite(values).all() or not values.any():
        return None
    values = values / np.abs(values).max()
    return values / np.sqrt((values * values).sum())


def plain(vectors, least=0.9):
    """(vec_id, n_links, component_id, kept) and the linked pairs, by comparing all pairs."""
    units = [unit(v) for _, v in vectors]
    parent, links, pairs = list(range(len(vectors))), [0] * len(vectors), set()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(units):
        for j, b in enumerate(units[:i]):
            if a is not None and b is not None and len(a) == len(b) and float(a @ b) >= least:
                links[i] += 1
                links[j] += 1
                pairs.add((j, i))
                parent[root(i)] = root(j)
    ids = {}
    for i, (vec_id, _) in enumerate(vectors):
        known = [x for x in (ids.get(root(i)), vec_id) if x is not None]
        ids[root(i)] = min(known, default=None)
    return [(v[0], links[i], ids[root(i)], v[0] == ids[root(i)]) for i, v in enumerate(vectors)], pairs


def turned(rng, vector, cosine):
    """A vector of any length at the given cosine to another."""
    vector = vector / np.linalg.norm(vector)
    other = rng.normal(size=len(vector))
    other -= (other @ vector) * vector
    return (cosine * vector + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)) * rng.uniform(0.1, 10)


def group(rng, centre, cosine, n):
    return [turned(rng, centre, cosine) for _ in range(n)]


def planted(rng, length=64):
    rows = [rng.normal(size=length) for _ in range(150)]
    rows += [turned(rng, rows[i % 150], 0.985) for i in range(200)]
    rows += group(rng, rows[0], 0.995, 120) + group(rng, rows[1], 0.97, 60)
    rows += [rows[2]] * 40 + [rows[2] * 2] * 3
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]


@pytest.mark.parametrize("tile", [embedding.TILE, 16])
def test_planted_groups_are_those_of_all_pairs(spark, tile):
    vectors = planted(np.random.default_rng(2))
    got = near_duplicates(table(spark, vectors), tile=tile).collect()
    assert sorted(map(tuple, got)) == sorted(plain(vectors)[0])


def test_recall_at_the_limit_itself(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(1500):
        one = rng.normal(size=64)
        rows += [one, turned(rng, one, rng.uniform(0.9005, 0.93))]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    found = near_duplicates(table(spark, vectors)).where("n_links > 0").count()
    assert found / 3000 > 0.95


def test_no_pair_below_the_limit_is_linked(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=64)
    rows = [one, *[turned(rng, one, c) for c in (0.899, 0.8999, 0.89)]]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    assert sorted(map(tuple, near_duplicates(table(spark, vectors)).collect())) == sorted(plain(vectors)[0])


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] * 4), (5, [nan] * 8), (6, [inf, 1.0] * 4), (None, None),
        (7, [1.0] * 8), (8, [1.0] * 8), (8, [1.0] * 8), (9, [2.0] * 8), (None, [3.0] * 8), (9, [-1.0] * 8), (10, [1.0] * 9),
        (None, [1.0, -1.0] * 4), (None, [2.0, -2.0] * 4), (11, [1e30] * 8), (12, [1e-30] * 8), (13, [-0.0, 1.0]), (14, [0.0, 1.0]),
        (15, [5.0]), (16, [7.0]), (17, [-7.0]),
    ]
    got = near_duplicates(table(spark, vectors))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(vectors)[0], key=str)


def test_doubles_and_other_settings(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in v]) for i, (_, v) in enumerate(planted(rng, 20))]
    docs = spark.createDataFrame([(i, v) for i, v in vectors], "vec_id int, embedding array<double>")
    got = near_duplicates(docs, least=0.95, tables=6, blocks=1, scale=0.5, probes=12, tile=64)
    assert sorted(map(tuple, got.collect())) == sorted(plain(vectors, 0.95)[0])


def test_nearest_points_are_lattice_points_and_nearest():
    rng = np.random.default_rng(9)
    x = rng.uniform(-3, 3, size=(2000, 8))
    near = embedding.nearest_points(x)
    doubled = np.rint(2 * near).astype(int)
    assert (doubled == 2 * near).all() and (np.ptp(doubled % 2, axis=1) == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    steps = embedding.shortest_vectors()
    assert len(np.unique(steps, axis=0)) == 240 and ((steps**2).sum(axis=1) == 2).all()
    farther = ((x[:, None, :] - near[:, None, :] - steps[None]) ** 2).sum(axis=2)
    assert (((x - near) ** 2).sum(axis=1)[:, None] <= farther + 1e-9).all()


def test_probed_cells_are_those_of_neighbouring_points():
    lattice = embedding.Lattice(10, 2, 1, 0.7, 5)
    rng = np.random.default_rng(10)
    unit_rows = rng.normal(size=(50, 10))
    unit_rows /= np.linalg.norm(unit_rows, axis=1, keepdims=True)
    cells = lattice.cells(unit_rows).reshape(50, 2, 6)
    for t in range(2):
        x = unit_rows @ lattice.project[t, 0] + lattice.shift[t, 0]
        point = embedding.nearest_points(x)
        for i in range(50):
            around = point[i] + lattice.steps
            names = (2 * around).astype(np.int64) @ lattice.factors[t, 0] + lattice.start[t]
            nearest = names[np.argsort(((x[i] - around) ** 2).sum(axis=1))[:5]]
            assert set(cells[i, t, 1:].tolist()) == set(nearest.tolist()) and cells[i, t, 0] not in nearest


def test_given_tables_against_sql(spark):
    con = connect(inputs.TABLES)
    query = QUERIES["op13_embedding_near_dedup"]
    assert not differences(spark, query, ORACLE["op13_embedding_near_dedup"], con, inputs.TABLES)


def test_empty(spark):
    assert near_duplicates(table(spark, [])).count() == 0
