from collections import defaultdict
from itertools import permutations

from checks.compare import connect, differences
from tests.llm import inputs
from tillstream.llm.filter_audit import all_orders, cells, filter_interactions, order_effects
from tillstream.llm.queries import ORACLE, QUERIES

LABELS = "doc_id long, quality int, toxic int"


def plain_failures(rows):
    """The letters that each row fails, from (doc_id, text)."""
    first = {}
    for doc_id, text in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = [w for w in inputs.spaces_to_one(text).split(" ") if w]
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        out.append(fails + "E" * (doc_id is not None and first[text] < doc_id))
    return out


def plain_audit(rows, marks):
    """Every order walked document by document. ``rows`` holds (doc_id, text, part)."""
    found = defaultdict(lambda: [0] * 6)
    removed_by = defaultdict(int)
    fails = plain_failures([r[:2] for r in rows])
    for order in map("".join, permutations("ABCDE")):
        for (doc_id, _, part), failing in zip(rows, fails, strict=True):
            good, toxic = marks.get(doc_id, (0, 0))
            gone = False
            for step, letter in enumerate(order, 1):
                counts = found[part or "", order, step]
                failed = letter in failing
                counts[0] += not gone and not failed
                counts[1] += not gone and failed
                counts[2] += gone and failed
                counts[3] += failing == letter
                counts[4] += good * (not gone and failed)
                counts[5] += toxic * (not gone and failed)
                removed_by[part or "", letter] += not gone and failed
                gone |= failed
    return sorted((p, o, s, *c, removed_by[p, o[s - 1]]) for (p, o, s), c in found.items())


def test_awkward_rows_against_documents_walked_one_by_one(spark):
    more = [
        (20, "UPPER Case & $ signs " * 30, "en", "a"), (21, "UPPER Case & $ signs " * 30, "en", "b"),
        (22, "one two " * 40, "en", ""), (23, inputs.sentence(23, 60) + " #", "en", None), (None, inputs.sentence(1), "en", "b"),
    ]
    rows = [*inputs.TEXTS, *more]
    labels = [(1, 1, 0), (20, 0, 1), (21, 1, 1), (21, 0, None), (7, 1, None), (None, 1, 1), (99, 1, 1), (5, None, 1)]
    marks = {1: (1, 0), 20: (0, 1), 21: (1, 1), 7: (1, 0), 5: (0, 1)}
    found = filter_interactions(inputs.documents(spark, rows), spark.createDataFrame(labels, LABELS))
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    ]
    want = plain_audit([(r[0], r[1], r[3]) for r in rows], marks)
    assert sorted(map(tuple, found.collect())) == want
    assert len(want) == 600 * 4


def test_shares_of_all_orders_add_up(spark):
    docs = spark.read.parquet(f"{inputs.TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{inputs.TABLES}/labels.parquet")
    counted = cells(docs, labels)
    effects = order_effects(counted, all_orders(spark))
    failing = {r["part"]: r["n"] for r in counted.where("mask > 0").groupBy("part").agg({"docs": "sum"}).toDF("part", "n").collect()}
    by_letter = defaultdict(int)
    for r in effects.where("step = 1").select("part", "filter_order", "shapley").collect():
        by_letter[r["part"], r["filter_order"][0]] = r["shapley"]
    for part, n in failing.items():  # each failing document is removed once in each order
        assert sum(v for (p, _), v in by_letter.items() if p == part) == 120 * n


def test_given_tables_against_sql(spark):
    con = connect(inputs.TABLES)
    query = QUERIES["op11_filter_audit"]
    assert not differences(spark, query, ORACLE["op11_filter_audit"], con, inputs.TABLES)


def test_empty(spark):
    assert filter_interactions(inputs.documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    kept = filter_interactions(inputs.documents(spark, [(1, None, None, None)]), spark.createDataFrame([], LABELS))
    assert kept.count() == 600 and kept.where("part <> ''").count() == 0
