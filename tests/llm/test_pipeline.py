"""The pipeline against its stages done plainly, one after the other."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from tests.llm import inputs, test_decontamination, test_simhash
from tillstream.llm import toxicity


def plain_stages(rows, known, items):
    """(doc_id, text) of the rows that the first four stages keep."""
    order = lambda i: (i is None, i or 0)
    rows = [r for r in rows if toxicity.score_text(r[1], known)[0] < toxicity.THRESHOLD]

    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[inputs.plain(text)].append((-len(text or ""), order(doc_id), doc_id, text))
    rows = [min(g, key=lambda m: m[:2])[2:] for g in groups.values()]

    prints = [(i, test_simhash.plain_fingerprint(t)) for i, t in rows]
    rows = [r for r, least in zip(rows, test_simhash.plain_components(prints), strict=True) if r[0] == least]
    return [r for r in rows if not test_decontamination.expected([r], items)[0][2]]


def test_rows_are_those_of_plain_stages(spark):
    docs = spark.read.parquet(f"{inputs.TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{inputs.TABLES}/labels.parquet")
    known = toxicity.WordScores(toxicity.trained(docs, labels))
    items = inputs.columns("benchmark", "item_id", "text")
    want = plain_stages(inputs.columns("documents", "doc_id", "text"), known, items)
    found = corpus_pipeline.run(spark, inputs.TABLES)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(i for i, _ in want)


def test_awkward_rows_through_all_stages(spark, tmp_path):
    passage = next(t for _, t in inputs.columns("benchmark", "item_id", "text") if len(t.split()) >= 10)
    rows = [*inputs.TEXTS, (20, f"so it says: {passage} {inputs.sentence(5)}", "en", "a")]
    rng = np.random.default_rng(4)
    said = [" ".join(rng.choice(inputs.WORDS, 40)) + ". you vile rotten" * (i % 5 == 0) for i in range(120)]
    marked = [(100 + i, text, "en", "a") for i, text in enumerate(said)]
    docs = inputs.documents(spark, rows + marked)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, int(i % 5 == 0), None) for i, *_ in marked] + [(None, 1, 1, "x"), (999, 0, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{inputs.TABLES}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    known = toxicity.WordScores(toxicity.trained(docs, labels))
    items = inputs.columns("benchmark", "item_id", "text")
    kept = plain_stages([r[:2] for r in rows + marked], known, items)
    ids = {i for i, _ in kept}
    assert len({1, 2, 3} & ids) == 1 and None in ids  # of copies one stays
    assert not {20, 100, 105, 18} & ids  # contaminated, toxic, a copy but for case
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for doc_id, text in kept:
        tokens = own.encode(text or "", add_special_tokens=False).ids
        decoded = own.decode(tokens, skip_special_tokens=False)
        want.append((doc_id, len(tokens), digest(" ".join(map(str, tokens))), digest(decoded)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{inputs.TABLES}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = stage(spark, docs, inputs.TABLES)
        assert docs_after.schema == docs.schema


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{inputs.TABLES}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, inputs.TABLES).count() == 0
