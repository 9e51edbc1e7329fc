import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import sale, star_of, values
from tillstream.operators import similarity, text
from tillstream.operators.similarity import recall, top_k_by_projections, top_k_similar
from tillstream.session import new_folder, written


@pytest.mark.parametrize("question, route, n", [
    ("What are the TOP 5 products by revenue?", "revenue_by_product", 5),
    ("best items please", "revenue_by_product", 10),
    ("top5 products, 7 or 9 of them", "revenue_by_product", 7),
    ("Monthly Sales so far", "revenue_by_month", None),
    ("revenue trend per country", "revenue_by_month", None),
    ("compare countries", "revenue_by_country", None),
    ("revenue by customer type", "revenue_by_segment", None),
    ("most profitable month for sales", "revenue_by_month", None),
    ("tell me a story", "retrieval", None),
])
def test_question_rules(spark, question, route, n):
    row = text.route_questions(spark.createDataFrame([(question,)], "question string")).first()
    assert (row["route"], row["top_n"]) == (route, n)


def test_documents(spark):
    made = star_of(spark, [sale("1", price=1234.5), sale("2", code="B", description="cup", price=1)])
    got = {r["text"]: r["metadata"] for r in text.warehouse_documents(made).collect()}
    assert got["In January 2020, total revenue was £1,235.50 across 2 orders."] == {
        "type": "monthly_revenue", "year": "2020", "month": "January"}
    assert got["Product 'thing' (price band: HIGH) generated £1,234.50 revenue from 1 units sold."][
        "price_band"] == "HIGH"
    assert got["France contributed £1,235.50 in total revenue."]["country"] == "France"
    assert "The MID-value customer segment contains 2 customers and contributed £1,235.50 in revenue." in got
    assert len(got) == 5


TEXTS = [
    (1, "red tea cups sold well red"), (2, "Blue garden chairs"), (3, "red garden lamps"), (4, ""), (5, None),
    (6, "blue garden\tchairs"), (7, "well well well"),
]


def plain_nearest(texts, question, k):
    """Cosine over all documents, by the definition."""
    terms = {i: (t or "").lower().split() for i, t in texts}
    known = {t for words in terms.values() for t in words}
    rare = {t: math.log((len(texts) + 1) / (sum(t in w for w in terms.values()) + 1)) for t in known}

    def unit(words):
        raw = {t: words.count(t) * rare[t] for t in words if t in rare}
        length = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / length for t, v in raw.items()} if length else {}

    asked = unit(question.lower().split())
    scores = [(round(sum(asked.get(t, 0) * v for t, v in unit(w).items()), 6), i) for i, w in terms.items() if set(w) & set(asked)]
    return [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.mark.parametrize("question", ["Garden chairs", "red well", "unknown words", "", "RED red tea lamps sold"])
def test_nearest_texts_equal_brute_force(spark, question):
    documents = spark.createDataFrame(TEXTS, "doc_id long, text string")
    path = new_folder(spark, "index")
    text.index_documents(documents, path)
    rarity, postings = text.load_index(spark, path)
    asked = spark.createDataFrame([(9, 1, question)], "conv long, turn int, text string")
    found = text.nearest_texts(asked, rarity, postings, ["conv", "turn"]).orderBy("place")
    assert values(found, "doc_id", "similarity") == plain_nearest(TEXTS, question, 3)


def test_answers(spark):
    made = star_of(spark, [sale("1", price=1234.5), sale("2", code="B", description="cup", price=1)])
    documents = text.warehouse_documents(made, None, None).withColumn("doc_id", F.monotonically_increasing_id())
    documents = written(documents, "documents")
    path = new_folder(spark, "index")
    text.index_documents(documents, path)
    asked = ["top 1 products", "best items", "sales trend", "compare countries", "which customer type", "'cup'", "'cup'", None]
    found = text.answer_questions(
        spark.createDataFrame([(q,) for q in asked], "question string"), made, documents, *text.load_index(spark, path))
    got = {(r["question"], r["place"]): (r["item"], r["revenue"]) for r in found.collect()}
    assert got["top 1 products", 1] == ("thing", 1234.5) and ("top 1 products", 2) not in got
    assert got["best items", 2] == ("cup", 1.0)
    assert got["sales trend", 1] == ("January 2020", 1235.5)
    assert got["compare countries", 1] == ("France", 1235.5)
    assert got["which customer type", 1][1] == 1235.5
    assert "'cup'" in got["'cup'", 1][0] and got["'cup'", 1][1] is None
    assert found.count() == len(got)


@pytest.mark.parametrize("buckets", [1, 5])
def test_nearest_vectors_equal_brute_force(spark, buckets):
    rng = np.random.default_rng(4)
    points, asked = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    points[17] = points[18]  # a tie
    points[200:] = points[3]  # a third are copies of one vector
    def frame(matrix, key):
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
        return spark.createDataFrame(rows, f"{key} long, vector array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = top_k_similar(frame(asked, "query_id"), frame(points, "vec_id"), buckets=buckets)
        rows = sorted(values(got, "query_id", "place", "vec_id"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(points).T, 6)
    wanted = [
        (q, place + 1, int(v))
        for q in range(40)
        for place, v in enumerate(sorted(range(300), key=lambda v: (-scores[q, v], v))[:3])
    ]
    assert rows == wanted


def test_zero_vectors_are_far_from_all(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, vector array<double>")
    asked = rows.select(F.col("vec_id").alias("query_id"), "vector")
    got = dict(((q, v), s) for q, v, s in values(top_k_similar(asked, rows), "query_id", "vec_id", "similarity"))
    assert got == {(1, 1): 0.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 1.0}


def test_projections_find_what_the_exact_join_finds(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    near = np.concatenate([centres + 0.1 * rng.normal(size=centres.shape) for _ in range(5)])
    schema = "id long, vector array<double>"
    points = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(near)], schema).toDF("vec_id", "vector")
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(centres)], schema).toDF("query_id", "vector")
    exact = top_k_similar(asked, points)
    found = top_k_by_projections(asked, points, width=0.8, tables=4)
    counted = recall(found, exact).first()
    assert counted["neighbours"] == 120 and counted["found"] >= 114
    scores = {(q, v): s for q, v, s in values(exact, "query_id", "vec_id", "similarity")}
    for q, v, s in values(found, "query_id", "vec_id", "similarity"):  # what is found has its exact score
        assert abs(scores.get((q, v), s) - s) < 2e-6
    narrow = recall(top_k_by_projections(asked, points, width=0.02, tables=1), exact).first()["found"]
    assert narrow < counted["found"]
    assert top_k_by_projections(asked, points, least=0.999999).count() < 10


def test_projections_with_vectors_that_are_near_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [3.0, 0.0])]
    points = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = top_k_by_projections(points.withColumnRenamed("vec_id", "query_id"), points)
    assert sorted(values(got, "query_id", "vec_id", "similarity")) == [(1, 1, 1.0), (1, 5, 1.0), (5, 1, 1.0), (5, 5, 1.0)]


def test_nearest_texts_in_many_blocks(spark, monkeypatch):
    """Documents and questions that are cut into blocks give what one block gives, keys without a value included."""
    monkeypatch.setattr(text, "_BLOCK_TERMS", 4)
    texts = [(None if i == 11 else i, " ".join(f"w{(i * j) % 13}" for j in range(1, 2 + i % 6))) for i in range(40)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    path = new_folder(spark, "index")
    text.index_documents(documents, path)
    rarity, postings = text.load_index(spark, path)
    asked = documents.where("doc_id is null or doc_id % 3 = 0").withColumnRenamed("doc_id", "conv")
    found = text.nearest_texts(asked, rarity, postings, ["conv"])
    wanted = sorted(
        (-1 if q is None else q, -1 if i is None else i, s)
        for q, t in texts if q is None or q % 3 == 0
        for i, s in plain_nearest([(-1 if i is None else i, t) for i, t in texts], t, 3)
    )
    assert sorted((-1 if q is None else q, -1 if i is None else i, s) for q, i, s in values(found, "conv", "doc_id", "similarity")) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # pairs of a question and a document are added up inside the tasks, not joined


def test_projections_in_many_cells(spark, monkeypatch):
    """Buckets that are cut into cells lose no pair, and copies of a vector count once."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 6)))]
    points = spark.createDataFrame(rows + rows[:9], "vec_id long, vector array<double>")
    asked = points.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, top_k_by_projections(asked, points).collect()))
    monkeypatch.setattr(similarity, "_CELL_VECTORS", 7)
    found = top_k_by_projections(asked, points)
    assert sorted(map(tuple, found.collect())) == whole and len(whole) == 45
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_rows_and_of_repeated_keys_together(spark):
    rows = [(1, "a b A  c"), (2, ""), (3, None), (4, "b\tb\nc"), (4, "c d"), (None, "a a"), (None, "a"), (5, "Ä ä x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = text._document_counts(documents, "doc_id")
    want = text.term_counts(documents, ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    alone = text._document_counts(documents.where("doc_id in (1, 2, 3, 5)"), "doc_id")
    assert "hashpartitioning(doc_id" not in alone._jdf.queryExecution().executedPlan().toString()
    assert got.schema.simpleString() == want.schema.simpleString()


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_postings_do_not_depend_on_the_terms_that_are_broadcast(spark, monkeypatch, frequent):
    rows = [(i, " ".join(f"t{j}" for j in range(i % 5 + 1))) for i in range(12)] + [(20, "t0 rare"), (None, "t0 t1")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    counts = text.term_counts(documents, ["doc_id"])
    rarity = counts.groupBy("term").agg(F.log(F.lit(15) / (F.count("*") + 1)).alias("rarity")).where("rarity > 0")
    monkeypatch.setattr(text, "FREQUENT_TERMS", frequent)
    got = text._with_rarity(counts, rarity)
    assert sorted(map(str, got.select("doc_id", "term", "tf", "rarity").collect())) == sorted(
        map(str, counts.join(rarity, "term").select("doc_id", "term", "tf", "rarity").collect()))


@pytest.mark.parametrize("sent", [2, 1_000])
@pytest.mark.parametrize("many_asked", [False, True])
def test_nearest_texts_copy_neither_side(spark, monkeypatch, sent, many_asked):
    """The larger side is dealt once, the other sent in blocks: no row is copied per block, and all results are there."""
    monkeypatch.setattr(text, "_BLOCK_TERMS", 4)
    monkeypatch.setattr(text, "_LEAST_TERMS", 3)
    monkeypatch.setattr(text, "_SENT_TERMS", sent)
    words = "red green blue black white grey".split()
    said = [(i, " ".join([words[i % 6], words[i % 5], words[i % 4]])) for i in range(12)]
    docs = spark.createDataFrame(said if not many_asked else said[:3], "doc_id long, text string")
    asked = spark.createDataFrame(said[:3] if not many_asked else said, "conv long, text string")
    path = new_folder(spark, "copies")
    text.index_documents(docs, path)
    rarity, postings = text.load_index(spark, path)
    got = text.nearest_texts(asked, rarity, postings, ["conv"])
    assert "explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
    weights = {}
    for r in postings.collect():
        weights.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    rare = {r["term"]: r["rarity"] for r in rarity.collect()}
    want = []
    for conv, said in ((r["conv"], r["text"].split()) for r in asked.collect()):
        mine = {t: said.count(t) * rare[t] for t in said if t in rare}
        length = sum(w * w for w in mine.values()) ** 0.5
        scores = [(-round(sum(w / length * theirs.get(t, 0) for t, w in mine.items()), 6), doc)
                  for doc, theirs in weights.items() if set(mine) & set(theirs)]
        want += [(conv, doc, place) for place, (_, doc) in enumerate(sorted(scores)[:3], 1)]
    assert want and sorted(tuple(r) for r in got.select("conv", "doc_id", "place").collect()) == sorted(want)


@pytest.mark.parametrize("most", [0, 100])
def test_weights_are_scaled_where_they_lie(spark, monkeypatch, most):
    """Lengths are broadcast, also that of a text without an id; above the limit weights meet by their text."""
    monkeypatch.setattr(text, "MOST_LENGTHS", most)
    raw = spark.createDataFrame(
        [(1, "a", 3.0), (1, "b", 4.0), (None, "a", 5.0), (None, "c", 12.0), (2, "a", 0.5)], "doc_id long, term string, raw double"
    )
    got = text._unit_where_they_lie(raw, "doc_id")
    assert ("Window" in got._jdf.queryExecution().optimizedPlan().toString()) == (most == 0)
    found = {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in got.collect()}
    assert found == {(1, "a"): 0.6, (1, "b"): 0.8, (None, "a"): round(5 / 13, 9), (None, "c"): round(12 / 13, 9), (2, "a"): 1.0}
