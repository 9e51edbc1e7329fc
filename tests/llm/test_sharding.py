import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm import inputs
from tillstream.llm.sharding import stratified_shards, write_shards
from tillstream.session import new_folder


def check(rows, texts, shards):
    """Laws of the assignment: whole, even, gapless, and every shard holds the mixture."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_source = Counter(r["source"] for r in rows)
    held = Counter((r["shard"], r["source"]) for r in rows)
    for source, total in by_source.items():
        for shard in range(shards):
            apart = abs(held[shard, source] - total * counts[shard] / len(rows))
            assert apart <= 2 or source == "hot" and apart <= 1 + len(by_source) ** 0.5


def test_awkward_rows(spark):
    check(stratified_shards(inputs.documents(spark)).collect(), inputs.TEXTS, 16)


def test_fewer_rows_than_shards(spark):
    check(stratified_shards(inputs.documents(spark, inputs.TEXTS[:5])).collect(), inputs.TEXTS[:5], 16)


def test_given_documents_with_a_hot_source(spark):
    rows = [(i, t, None, "hot" if i % 3 else s) for i, t, s in inputs.columns("documents", "doc_id", "text", "source")]
    docs = inputs.documents(spark, rows)
    found = stratified_shards(docs, shards=7).collect()
    check(found, rows, 7)
    again = stratified_shards(docs.repartition(5), shards=7).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in found) == sorted(
        (r["doc_id"], r["shard"], r["slot"]) for r in again
    )
    other = stratified_shards(docs, shards=7, seed=1).collect()
    assert {r["doc_id"]: r["shard"] for r in found} != {r["doc_id"]: r["shard"] for r in other}


def test_order_is_that_of_fractional_ranks(spark):
    totals = {"a": 60, "b": 30, "c": 1}
    rows = [(i, f"t{i}", None, s) for s, n in totals.items() for i in range(n)]
    found = sorted(stratified_shards(inputs.documents(spark, rows), shards=3).collect(), key=lambda r: (r["shard"], r["slot"]))
    hashes = spark.sql("SELECT source, xxhash64(17, source) AS h FROM VALUES ('a'), ('b'), ('c') t(source)").collect()
    begin = {r["source"]: (r["h"] % 2**20 + 0.5) / 2**20 for r in hashes}
    fractions, seen = [], Counter()
    for r in found:
        fractions.append((seen[r["source"]] + begin[r["source"]]) / totals[r["source"]])
        seen[r["source"]] += 1
    assert fractions == sorted(fractions)


def test_single_rows_of_many_sources_spread(spark):
    rows = [(i, f"t{i}", None, f"s{i}") for i in range(400)]
    found = stratified_shards(inputs.documents(spark, rows), shards=4).collect()
    assert {r["shard"] for r in found} == {0, 1, 2, 3}
    assert len({r["doc_id"] // 100 for r in found if r["shard"] == 0}) == 4


def test_written_shards(spark):
    path = new_folder(spark, "shards")
    docs = inputs.documents(spark)
    write_shards(docs, path, shards=4)
    back = spark.read.parquet(path)
    assert Counter(back.select("doc.*").collect()) == Counter(docs.collect())
    sizes = back.groupBy("shard_no").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sorted(r["n"] for r in sizes) == [5, 5, 5, 5] and all(r["last"] == r["n"] - 1 for r in sizes)


def test_empty(spark):
    assert stratified_shards(inputs.documents(spark, [])).count() == 0
