import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import inputs
from tillstream.llm import token_counts as counts

RANKS = counts.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
COUNTER = counts.Counter(public_tokenizers.PATTERN, RANKS)
LIBRARY = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

PARTS = st.sampled_from(["a", "b", "'", "'re", "'l", "l", " ", "  ", "\n", "\t ", "1", "23", "!", "é", " x", "\n\n  "])
TEXT = st.lists(PARTS, max_size=400).map("".join)


def whole(text):
    return len(LIBRARY.encode_ordinary(text))


def built(text):
    chars, tokens = counts.leaves_of(COUNTER.split.findall(text), COUNTER)
    return chars, counts.tree_of(tokens)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 900), st.integers(0, 60), TEXT.map(lambda t: t[:12])), max_size=6))
def test_edits_give_the_count_of_the_new_text(text, raw):
    chars, tree = built(text)
    assert tree[1] == whole(text)
    for _ in range(2):  # edits on edited trees too
        edits = [(start, start + length, put) for start, length, put in raw]
        text, chars, tree, _ = counts.recount(text, chars, tree, edits, COUNTER)
        assert tree[1] == whole(text) and chars.sum() == len(text)
        assert (counts.tree_of(tree[len(tree) // 2 :]) == tree).all()


def test_only_the_touched_region_is_encoded():
    text = " ".join(random.Random(1).choices(inputs.WORDS, k=20_000))
    chars, tree = built(text)
    new, _, after, encoded = counts.recount(text, chars, tree, [(50_000, 50_003, "XYZ")], COUNTER)
    assert after[1] == whole(new) and encoded <= 3 * counts.LEAF_TOKENS


@pytest.mark.parametrize("use", [
    lambda spark, p: counts.Counter(p, RANKS), lambda spark, p: counts.count_trees(spark, p, RANKS),
    lambda spark, p: counts.recounted(spark, p, RANKS),
])
def test_a_pattern_that_looks_further_is_refused(spark, use):
    with pytest.raises(ValueError):
        use(spark, r"\s*[\r\n]+|" + public_tokenizers.PATTERN)
    use(spark, public_tokenizers.PATTERN)


def test_overlapping_edits():
    kept = counts.clean_edits([(5, 9, "b"), (2, 6, "a"), (9, 9, "c")], 12)
    assert kept == [(2, 6, "a"), (9, 9, "c")]


def test_awkward_rows(spark):
    rows = [
        *inputs.TEXTS, (21, "mail me.too@example.org or +1 (555) 010-9999\nline\nother\nline\nline", None, None),
        (22, "line\n\n\nline", None, None),
    ]
    found = counts.edited_counts(inputs.documents(spark, rows), public_tokenizers.PATTERN, RANKS).collect()
    got = sorted([(r["doc_id"], r["n_tokens"], r["n_edits"], r["after"]["text"], r["after"]["n_tokens"]) for r in found], key=str)
    want = []
    for doc_id, text, *_ in rows:
        edits = [(e["start"], e["end"], e["put"]) for e in counts.redactions(text)]
        new = counts.edited(text or "", counts.clean_edits(edits, len(text or "")))
        want.append((doc_id, whole(text or ""), len(edits), new, whole(new)))
    assert got == sorted(want, key=str)
    texts = {r["doc_id"]: r["after"]["text"] for r in found}
    assert texts[21] == "mail [redacted] or [redacted]\nline\nother\n" and texts[22] == "line\n\n\n"


def test_null_edits_change_nothing(spark):
    text = "one two three"
    rows = spark.createDataFrame(
        [(text, None), (text, [None, (0, None, "x"), (None, 3, "x"), (0, 3, None)]), (None, [(0, 5, "new")])],
        f"text string, edits {counts.EDITS_TYPE}",
    )
    tree = counts.count_trees(spark, public_tokenizers.PATTERN, RANKS).alias("tree")
    after = counts.recounted(spark, public_tokenizers.PATTERN, RANKS).alias("after")
    found = [r["after"] for r in rows.select("text", "edits", tree).select(after).collect()]
    assert [(f["text"], f["n_tokens"]) for f in found] == [(text, whole(text))] * 2 + [("new", whole("new"))]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)]])
def test_empty(spark, rows):
    found = counts.edited_counts(inputs.documents(spark, rows), public_tokenizers.PATTERN, RANKS).collect()
    assert [r["n_tokens"] for r in found] == [0] * len(rows)
