import os
import re
import subprocess
import sys

from tests.llm import inputs
from tillstream.llm.decontamination import Windows, benchmark_hits, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, size=10):
    windows = [(str(i), w[k : k + size]) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - size + 1)) if w]
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        places = {}
        for place, word in enumerate(own):
            places.setdefault(word, []).append(place)
        for item, window in windows:
            for start in places.get(window[0], []):
                if own[start : start + len(window)] == window:
                    hit |= set(range(start, start + len(window)))
                    found.add(item)
        out.append((doc_id, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()], key=str)


PASSAGE = "What is the Capital of France, and which river – the Seine? – runs through it today"
ITEMS = [
    (1, PASSAGE), (2, PASSAGE + " or tomorrow"), (3, "short item"), (3, "short item"), (4, None), (5, ""), (6, "..."),
    (7, "été à Paris"), (None, "no id"),
]
DOCS = [
    (1, f"Before. {PASSAGE.upper().replace('–', '-')}! After", None, None), (2, "a SHORT\nitem, shortitem", None, None),
    (3, "no match of short items", None, None), (4, "ÉTÉ à paris été à  paris", None, None),
    (5, "x " + " ".join(words(PASSAGE)[2:]) + " y", None, None), *inputs.TEXTS,
]


def test_awkward_rows(spark):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    want = expected([d[:2] for d in DOCS], [i for i in ITEMS if i[0] is not None])
    assert found(benchmark_hits(inputs.documents(spark, DOCS), benchmark)) == want
    # In several automata, one pass each.
    assert found(benchmark_hits(inputs.documents(spark, DOCS), benchmark, max_bytes=60)) == want
    kept = drop_contaminated(inputs.documents(spark, DOCS), benchmark, max_bytes=60)
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([w[0] for w in want if not w[2]], key=str)
    assert kept.schema == inputs.documents(spark, []).schema


def test_items_without_an_id_contaminate(spark):
    rows = [(None, PASSAGE), (None, "no id"), (None, "another one"), (3, "short item")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    texts = [(1, f"x {PASSAGE} y"), (2, "there is no id, a short item"), (3, "not another 1"), (4, "another ONE")]
    docs = inputs.documents(spark, [(i, t, None, None) for i, t in texts])
    n = [len(words(t)) for _, t in texts]
    want = [(1, n[0], n[0] - 2, []), (2, n[1], 4, ["3"]), (3, n[2], 0, []), (4, n[3], 2, [])]
    for most in (16_000_000, 30):
        assert found(benchmark_hits(docs, benchmark, max_bytes=most)) == want
        assert [r["doc_id"] for r in drop_contaminated(docs, benchmark, max_bytes=most).collect()] == [3]


def test_spans_are_places_in_the_original(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    for row in benchmark_hits(inputs.documents(spark, DOCS[:5]), benchmark).collect():
        text = DOCS[row["doc_id"] - 1][1]
        for span in row["spans"]:
            assert words(text[span["start"] : span["end"]]) == words(text)[span["first_word"] : span["end_word"]]


def test_given_documents(spark):
    docs, items = inputs.columns("documents", "doc_id", "text"), inputs.columns("benchmark", "item_id", "text")
    read = lambda name: spark.read.parquet(f"{inputs.TABLES}/{name}.parquet")
    want = expected(docs, items)
    assert any(w[2] for w in want)
    assert found(benchmark_hits(read("documents"), read("benchmark"))) == want


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = inputs.documents(spark)
    assert found(benchmark_hits(docs, none)) == expected([r[:2] for r in inputs.TEXTS], [])
    assert drop_contaminated(docs, none).count() == docs.count()
    assert benchmark_hits(inputs.documents(spark, []), none).count() == 0


def test_the_automaton_of_a_full_pass_stays_small():
    """As many bytes as one pass takes, of words without any repeats, in a process of its own."""
    code = (
        "import random, resource; from tillstream.llm import decontamination as d; rng = random.Random(1);"
        "words = [''.join(rng.choices('abcdefghijklmnop', k=8)) for _ in range(40_000)];"
        "items = [(str(i), ' '.join(rng.choices(words, k=100))) for i in range(d.MAX_BENCHMARK_BYTES // 900)];"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
        "found = d.Windows(items, 10); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(done.stdout) < 400_000  # kB


def test_words_outside_the_benchmark_and_windows_at_word_ends_only():
    items = [(f"i{n}", f"w{n} w{n + 1}") for n in range(700)] + [("short", "w5")]  # numbers of two characters
    windows = Windows(items, 2)
    assert windows.width == 2
    words = [f"w{n}".encode() for n in (3, 4, 900, 4, 5, 6, 8)]
    found = sorted((first, end, sorted(windows.names[p] for p in places)) for first, end, places in windows.matches(words))
    assert found == [(0, 2, ["i3"]), (3, 5, ["i4"]), (4, 5, ["short"]), (4, 6, ["i5"])]
