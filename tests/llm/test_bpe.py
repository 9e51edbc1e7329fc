from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import inputs
from tillstream.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def by_library(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    return Counter(out)


def found(docs, **options):
    rows = bpe.encode_decode(docs, bpe.read_vocabulary(PATH), **options).collect()
    return Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows)


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_awkward_rows(spark, library, hot):
    rows = [*inputs.TEXTS, (21, "a<|endoftext|>b <|ENDOFTEXT|><|startoftext|>", None, None), (22, "'S it's IT'LL ''re \x1c\x85\xa0y", None, None)]
    assert found(inputs.documents(spark, rows), hot=hot) == by_library(library, [r[:2] for r in rows])


def test_given_documents(spark, library):
    docs = spark.read.parquet(f"{inputs.TABLES}/documents.parquet")
    assert found(docs, hot=500) == by_library(library, inputs.columns("documents", "doc_id", "text"))


def test_ids_of_other_types_and_blocks_that_end_early(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    rows = [(f"d{i % 7}" if i % 5 else None, ["", "some words", "zxqv " * (i % 9), None][i % 4]) for i in range(40)]
    docs = spark.createDataFrame(rows * 2, "doc_id string, text string")
    assert found(docs, hot=1) == by_library(library, rows * 2)


def test_every_character(library):
    vocabulary = bpe.read_vocabulary(PATH)
    split, encode = bpe.Splitter(vocabulary), vocabulary.encoder()
    for code in [*range(0x3100), 0xFB01, 0x1D400, 0x1F600, 0x2F800]:
        text = f"a{chr(code)}B1 {chr(code)}{chr(code)}9 '{chr(code)}"
        assert [i for w in split(text) for i in encode(w)] == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_hot_words_are_the_most_frequent_whole_steps(spark):
    rows = [(f"w{i}", n) for i, n in enumerate([100, 90, 50, 7, 7, 7, 1])]
    words = spark.createDataFrame(rows, "word string, rows long")
    found = [sorted(r["word"] for r in bpe.hot_words(words, most).collect()) for most in range(8)]
    assert all(len(hot) <= most and hot == [f"w{i}" for i in range(len(hot))] for most, hot in enumerate(found))
    assert [len(hot) for hot in found] == [0, 1, 2, 3, 3, 3, 6, 7]


def test_packed_sequences():
    rng = np.random.default_rng(1)
    for size in (0, 1, 700):
        numbers = rng.integers(0, 2**24, size)
        gaps = ["é", "<|endoftext|>", "a"] if size else []
        data = bpe.packed(numbers, gaps) + b"\x01"
        assert (bpe.packed_numbers(data) == numbers).all() and bpe.packed_gaps(data) == gaps


def test_decoding_ids_without_a_piece(spark):
    vocabulary = bpe.read_vocabulary(PATH)
    rows = spark.createDataFrame([([256, 10**6, -1, 49407],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in rows.select(bpe.decoded(spark, vocabulary)).collect()] == ["!</w> <|endoftext|>", "", ""]


def test_other_vocabularies_are_refused():
    with open(PATH, encoding="utf-8") as file:
        text = file.read()
    with pytest.raises(ValueError):
        bpe.Vocabulary(text.replace('"NFC"', '"NFD"', 1))


def test_empty(spark):
    assert not found(inputs.documents(spark, []))
