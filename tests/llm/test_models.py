"""The three trained operators: held-out results, plain versions of their scores, awkward rows."""

import re

import numpy as np
import pytest

from tests.llm import inputs
from tillstream.llm import language, quality, toxicity
from tillstream.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(
        [(i, q, t, "x", 1) for i, q, t in rows], "doc_id long, quality int, toxic int, text string, score int"
    )


def held_out(spark, name, label):
    truth = dict(inputs.columns("labels", "doc_id", label, tables=LARGER))
    rows = [r for r in QUERIES[name](spark, LARGER).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    return np.array([truth[r["doc_id"]] for r in rows]), np.array([r["score"] for r in rows]), rows


def test_toxicity_held_out(spark):
    truth, score, rows = held_out(spark, "op6_toxicity", "toxic")
    assert len(truth) > 50 and ((score >= 0.7) == (truth == 1)).mean() > 0.93
    assert (score[truth == 0] >= 0.7).mean() < 0.03
    texts = dict(inputs.columns("documents", "doc_id", "text", tables=LARGER))
    marked = [r for r in rows if r["predicted"]]
    insults = re.compile("idiot|moron|scum|stupid|trash|clown|loser|worthless|pathetic|disgusting")
    hits = [bool(insults.search(texts[r["doc_id"]][r["start"] : r["end"]].lower())) for r in marked]
    assert np.mean(hits) > 0.7  # the sentence that it points out is the offending one


def test_very_long_clean_texts_stay_below_the_limit(spark):
    read = lambda name: spark.read.parquet(f"{LARGER}/{name}.parquet")
    known = toxicity.WordScores(toxicity.trained(read("documents"), read("labels")))
    truth = dict(inputs.columns("labels", "doc_id", "toxic", tables=LARGER))
    texts = [(truth.get(i), t, *toxicity.score_text(t, known)) for i, t in sorted(
        inputs.columns("documents", "doc_id", "text", tables=LARGER)) if inputs.share(i, toxicity.PARTS) == toxicity.HELD_OUT]
    clean = [(t, len(each)) for label, t, score, each in texts if label == 0 and score < toxicity.THRESHOLD]
    bad, each = next((t, each) for label, t, score, each in texts if label == 1 and each.max() > 3)
    start, end, _ = toxicity.worst_sentence(bad, each)
    for least in (10_000, 30_000):
        long = ". ".join(t for t, _ in clean * -(-least // sum(n for _, n in clean)))
        score, sentences = toxicity.score_text(long, known)
        assert len(sentences) >= least and score < toxicity.THRESHOLD
        assert toxicity.score_text(f"{long}. {bad[start:end]}", known)[0] >= toxicity.THRESHOLD


def test_quality_held_out(spark):
    truth, score, _ = held_out(spark, "op4_quality", "quality")
    assert len(truth) > 50 and ((score >= 0.7) == (truth == 1)).mean() > 0.95


def test_language_held_out(spark):
    truth = dict(inputs.columns("documents", "doc_id", "lang", tables=LARGER))
    rows = [r for r in QUERIES["op7_language"](spark, LARGER).collect() if r["held_out"]]
    assert len(rows) > 200 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95


def test_held_out_rows_are_never_learnt_from(spark):
    rows = [(i, "good words here" if i % 2 else "bad idiot", None, "a") for i in range(60)]
    sample = toxicity.labelled_sample(
        inputs.documents(spark, rows), labels_of(spark, [(i, 1, i % 2) for i in range(60)]), "toxic", 3, 1, 1000, 10_000
    )
    assert sample.count() == sum(inputs.share(i, 3) != 1 for i in range(60))
    pieces = language.training_rows(inputs.documents(spark, [(i, f"text {i}", "en", "a") for i in range(60)]))
    assert {r["text"].split()[-1] for r in pieces.collect()} == {str(i) for i in range(60) if inputs.share(i, 3) != 1}


def test_sample_is_bounded_and_steady(spark):
    rows = [(i, f"text {i}", None, "a") for i in range(200)]
    labels = labels_of(spark, [(i, 1, i % 2) for i in range(200)] + [(5, 0, None), (None, 1, 1)])
    take = lambda docs: sorted(
        r["text"] for r in toxicity.labelled_sample(docs, labels, "toxic", 3, 1, 20, 1000).collect()
    )
    docs = inputs.documents(spark, rows)
    assert len(take(docs)) == 20 and take(docs) == take(docs.repartition(7))
    assert take(docs.unionByName(docs)) == take(docs)  # rows repeated in full


def test_sample_is_bounded_in_bytes_and_not_shrunk_by_labels_of_other_documents(spark):
    rows = [(i, "é" * (100 if i % 4 else 5000), None, "a") for i in range(200)] + [(300, None, None, "a"), (None, "x", None, "a")]
    labels = labels_of(spark, [(i, 1, i % 2) for i in range(5000)] + [(None, 1, 1)])
    found = toxicity.labelled_sample(inputs.documents(spark, rows), labels, "toxic", 3, 1, 90, 100_000).collect()
    assert len(found) > 80 and all(len(r["text"]) == 100 for r in found)  # longer ones are over a hundredth
    few = toxicity.labelled_sample(inputs.documents(spark, rows), labels, "toxic", 3, 1, 90, 20_000).collect()
    assert sum(len(r["text"].encode()) for r in few) <= 20_000 and 85 < len(few) <= 90


def test_noisy_or_is_that_of_its_sentences():
    known = toxicity.WordScores(toxicity.ToxicityModel({"idiot": 6.0, "^stup": 3.0, "nice": -2.0}, -4.0))
    text = "A nice day. You idiot!\nStupidly idiot\n... 12 . end"
    z = [-4.0 - 2.0, -4.0 + 6.0, -4.0 + 3.0 + 6.0, -4.0]
    want = 1 - np.prod([1 - 1 / (1 + np.exp(-v)) for v in z])
    score, each = toxicity.score_text(text, known)
    assert score == pytest.approx(want)
    start, end, worst = toxicity.worst_sentence(text, each)
    assert text[start:end] == "Stupidly idiot\n" and worst == pytest.approx(1 / (1 + np.exp(-5.0)))


def test_toxicity_finds_planted_sentences(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        said = [" ".join(rng.choice(inputs.WORDS, 6)) for _ in range(8)]
        if i % 5 == 0:
            said[i % 8] = " ".join(rng.choice(inputs.WORDS, 3)) + " vile rotten"
        rows.append((i, ". ".join(said) + ".", None, "a"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = inputs.documents(spark, rows)
    model = toxicity.trained(docs, labels_of(spark, labels))
    for r in toxicity.toxicity_scores(docs, model).collect():
        assert (r["score"] >= 0.7) == (r["doc_id"] % 5 == 0)
        if r["score"] >= 0.7:
            assert "vile rotten" in rows[r["doc_id"]][1][r["start"] : r["end"]]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == 480


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1)], [(1, None, None)]])
def test_without_two_classes(spark, labels):
    docs, marks = inputs.documents(spark), labels_of(spark, labels)
    model = toxicity.trained(docs, marks)
    scores = [r["score"] for r in toxicity.toxicity_scores(docs, model).collect()]
    assert len(scores) == len(inputs.TEXTS) and all(0 <= s <= 1 for s in scores)
    scores = [r["score"] for r in quality.quality_scores(docs, marks).collect()]
    assert len(scores) == len(inputs.TEXTS) and len(set(scores)) == 1


def test_awkward_rows(spark):
    docs = inputs.documents(spark)
    marks = labels_of(spark, [(i, i % 2, i % 2) for i in range(20)] + [(3, 0, 1), (None, 1, 1), (99, 1, 1)])
    for scores in (toxicity.toxicity_scores(docs, toxicity.trained(docs, marks)), quality.quality_scores(docs, marks)):
        rows = scores.collect()
        assert sorted([r["doc_id"] for r in rows], key=str) == sorted([t[0] for t in inputs.TEXTS], key=str)
        assert all(0 <= r["score"] <= 1 for r in rows)
    found = language.languages(docs, language.trained(docs)).collect()
    unknown = sorted(r["doc_id"] for r in found if r["lang_pred"] == "und")
    assert len(found) == len(inputs.TEXTS) and unknown == [4, 5, 6, 12]
    assert all(0 <= r["score"] <= 1 for r in found)


def test_empty_tables(spark):
    docs, marks = inputs.documents(spark, []), labels_of(spark, [])
    assert toxicity.toxicity_scores(docs, toxicity.trained(docs, marks)).count() == 0
    assert quality.quality_scores(docs, marks).count() == 0
    assert language.languages(docs, language.trained(docs)).count() == 0


def test_no_language_is_left_out_of_the_sample(spark):
    ids = [i for i in range(4_000) if inputs.share(i, 3) != 1]
    rows = [(i, f"text number {i}", f"l{place % 600}", "a") for place, i in enumerate(ids)]
    docs = inputs.documents(spark, rows)
    assert {r["lang"] for r in language.training_rows(docs).collect()} == {f"l{n}" for n in range(600)}
    few = [r["lang"] for r in language.training_rows(docs, most=600).collect()]
    assert len(set(few)) == 600 and len(few) < 0.7 * len(rows)


def test_no_language_learnt():
    assert language.fit([], []).predict("some text") == ("und", 0.0)


def test_discriminant_is_the_difference_of_gaussian_densities():
    rng = np.random.default_rng(2)
    width = len(quality.STATISTICS)
    x = np.concatenate((rng.normal(0, 1, (400, width)), rng.normal(0.8, 2, (300, width))))
    label = np.repeat([0, 1], [400, 300])
    ones = np.hstack((np.ones((700, 1)), x))
    model = quality.discriminant({k: ones[label == k].T @ ones[label == k] for k in (0, 1)})
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    spread = [np.cov(z[label == k].T, bias=True) for k in (0, 1)]
    pooled = (400 * spread[0] + 300 * spread[1]) / 700
    density = []
    for k in (0, 1):
        mixed = 0.9 * spread[k] + 0.1 * pooled
        mixed = 0.95 * mixed + 0.05 * np.eye(width) * np.trace(mixed) / width
        apart = z - z[label == k].mean(axis=0)
        square = np.einsum("ij,jk,ik->i", apart, np.linalg.inv(mixed), apart)
        density.append(-0.5 * square - 0.5 * np.linalg.slogdet(mixed)[1] + np.log([400, 300][k] / 700))
    assert np.allclose(np.sinh(model.squeezed(x)), density[1] - density[0], rtol=1e-6)


def test_network_scores_are_those_of_the_unfolded_convolution():
    texts = [t for _, t in inputs.columns("documents", "doc_id", "text")][:40]
    model = language.fit(texts, ["a" if i % 2 else "b" for i in range(len(texts))])
    ids = language.windows("Plain text, é.".encode())
    span = ids.shape[1] - len(model.tables) + 1
    best = np.full(model.tables.shape[2], -np.inf)
    for place in range(span):
        best = np.maximum(best, sum(model.tables[k][ids[0, place + k]] for k in range(len(model.tables))))
    assert np.allclose(model.pooled(ids)[0], np.maximum(best + model.bias, 0), atol=1e-4)
