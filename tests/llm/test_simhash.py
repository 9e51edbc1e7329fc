import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm import inputs
from tillstream.llm import simhash
from tillstream.llm.components import components
from tillstream.llm.simhash import drop_near_duplicates, fingerprint_of, near_duplicates


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    for space in "\t\n\x0b\x0c\r":
        words = [w for word in words for w in word.split(space)]
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    """(doc_id, fingerprint) to smallest reachable id, by comparing all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(root(i)), doc_id) if x is not None]
        least[root(i)] = min(ids, default=None)
    return [least[root(i)] for i in range(len(rows))]


def unsigned(x):
    return x & (2**64 - 1)


def check(spark, docs, rows, **options):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted(zip(prints, plain_components(prints), strict=True), key=str)
    got = near_duplicates(docs, **options).collect()
    assert sorted((((r[0], unsigned(r["fingerprint"])), r["component_id"]) for r in got), key=str) == want


def test_fingerprints_of_plain_texts():
    for _, text, *_ in inputs.TEXTS[:13]:
        assert unsigned(fingerprint_of((text or "").encode())) == plain_fingerprint(text)


def test_awkward_rows(spark):
    check(spark, inputs.documents(spark), [r[:2] for r in inputs.TEXTS])


def test_given_documents_with_small_tiles(spark):
    rows = inputs.columns("documents", "doc_id", "text")
    check(spark, spark.read.parquet(f"{inputs.TABLES}/documents.parquet"), rows, tile=3)


def test_links_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900).astype("<u8")
    near = np.concatenate([base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(4)])
    values = np.unique(np.concatenate((base, near, near ^ np.uint64(0b1011))))
    left, right = values[::2].copy(), values[1::2].copy()
    got = set()
    for i, j in simhash.links_within(left, right, 4):
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert got == set(zip(*np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= 4), strict=True))


def test_pairs_of_tiles_are_those_of_all_cells_and_spread_over_tasks(spark):
    rng = np.random.default_rng(6)
    values = np.unique(rng.integers(-(2**63), 2**63 - 1, 6_000))
    nodes = spark.createDataFrame([(int(v),) for v in values], "fingerprint long")
    halves = np.bitwise_count(values.astype("<i8").view("<u4").reshape(-1, 2)).astype(int)
    near = np.abs(halves[:, None, :] - halves[None, :, :]).sum(axis=2) <= 4
    pairs = simhash.tile_pairs(nodes, 4, 20, work=2e5)
    found = pairs.select(F.spark_partition_id().alias("task"), "mine", "theirs").collect()
    met, work = np.zeros(near.shape, dtype=int), {}
    for task, mine, theirs in found:
        work[task] = work.get(task, 0) + len(mine) * len(theirs)
        i, j = np.searchsorted(values, mine), np.searchsorted(values, theirs)
        met[np.ix_(i, j)] += 1
        if i[0] != j[0]:
            met[np.ix_(j, i)] += 1
    assert (met == near).all()  # each pair that the counts allow once, the others never
    assert len(work) > 20 and max(work.values()) < 2 * np.median(list(work.values()))


def test_neighbours_cover_every_pair_of_cells_once():
    steps = simhash._neighbours(4)
    for a in range(-5, 6):
        for b in range(-5, 6):
            near = abs(a) + abs(b) <= 4
            assert ((a, b) in steps) + ((-a, -b) in steps) == (near if (a, b) != (0, 0) else 2)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 400)] + [(500, 501), (500, 502), (501, 502)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "low long, high long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 400)} | {i: 500 for i in (500, 501, 502)}


def test_a_large_group_of_near_copies_gives_rows_in_proportion(spark):
    rng = np.random.default_rng(5)
    group = np.unique(np.int64(12345) ^ (np.int64(1) << rng.integers(0, 62, (4000, 2))).sum(axis=1))
    nodes = spark.createDataFrame([(int(v), int(i)) for i, v in enumerate(group)], "fingerprint long, least_id long")
    links = simhash.linked(nodes, tile=500)
    assert links.count() < 60 * len(group)
    assert components(links).select("component").distinct().count() == 1


def test_dropping_keeps_one_of_each_component(spark):
    docs = inputs.documents(spark)
    kept = drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    prints = [(r[0], plain_fingerprint(r[1])) for r in inputs.TEXTS]
    ids = sorted([r["doc_id"] for r in kept.collect()], key=str)
    groups = {(c, i) for i, c in enumerate(plain_components(prints))}
    roots = {c for c, _ in groups}
    assert set(ids) == roots
    assert drop_near_duplicates(kept).count() == len(ids)


def test_empty(spark):
    docs = inputs.documents(spark, [])
    assert near_duplicates(docs).count() == 0 and drop_near_duplicates(docs).count() == 0
