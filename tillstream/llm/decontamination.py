r"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Texts are taken as UTF-8 bytes: A-Z are lower-cased and every byte that is no word character becomes
a space, byte for byte, so a word keeps its place in the original. The automaton holds every window
of ten consecutive words of each benchmark item, as the words' numbers; an item of fewer words is one
window. Each document is scanned once, and all words inside an occurrence are hit.

The benchmark's texts are broadcast, and each worker builds the automaton of them. Above ``MAX_BENCHMARK_BYTES`` of text the items are dealt into
as many automata as needed, each of which scans the documents in a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.session import written

WINDOW_WORDS = 10
# Benchmark text of one automaton, whose size in a worker is some 140 times as much; more text takes further passes.
MAX_BENCHMARK_BYTES = 2_000_000

# Characters in which word numbers are written.
_DIGITS = 256

# Byte to byte: [0-9a-z] and all bytes above 0x7F stay, A-Z are lower-cased, the rest are spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()),
                                      ("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
FOUND_TYPE = (
    "n_words long, n_hit long, items array<string>, "
    "spans array<struct<first_word: int, end_word: int, start: int, end: int>>"
)


class Windows:
    """The windows of the benchmark's items in one automaton, and the items of each.

    A word is its number among the benchmark's words, written in as few characters as all numbers need, the same
    for each; 0 is any other word. So an occurrence is one whose end falls on the end of a word.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        import ahocorasick

        texts = [(text or "").encode().translate(WORD_BYTES).split() for _, text in items]
        words = sorted({w for text in texts for w in text})
        self.names = [item for item, _ in items]
        self.width = 1
        while _DIGITS**self.width <= len(words):
            self.width += 1
        self.other = chr(0) * self.width
        self.codes = {w: self._code(n) for n, w in enumerate(words, 1)}
        self.automaton = ahocorasick.Automaton()
        for place, text in enumerate(texts):
            whole = "".join(map(self.codes.__getitem__, text))
            for start in range(max(1, len(text) - size + 1) if text else 0):
                window = whole[start * self.width : (start + size) * self.width]
                known = self.automaton.get(window, None)
                if known is None:
                    self.automaton.add_word(window, (len(window) // self.width, place))
                elif place not in known[1:]:
                    self.automaton.add_word(window, (*known, place))
        if words:
            self.automaton.make_automaton()

    def _code(self, number: int) -> str:
        return "".join(chr(number // _DIGITS**k % _DIGITS) for k in range(self.width))

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """First word, end and items of each window that occurs."""
        if not self.codes or not words:
            return
        code_of, other, width = self.codes.get, self.other, self.width
        for last, (count, *places) in self.automaton.iter("".join([code_of(w, other) for w in words])):
            end, rest = divmod(last + 1, width)
            if not rest:
                yield end - count, end, places


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges, in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def word_places(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a translated text."""
    inside = np.concatenate(([False], np.frombuffer(plain, dtype=np.uint8) != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def scan(raw: bytes, windows: Windows, before: dict | None = None) -> dict:
    """What the automaton finds in a text, joined with what earlier automata found."""
    plain = raw.translate(WORD_BYTES)
    words = plain.split()
    items = set(before["items"]) if before else set()
    ranges = [(s["first_word"], s["end_word"]) for s in before["spans"]] if before else []
    for first, end, places in windows.matches(words):
        ranges.append((first, end))
        items.update(windows.names[place] for place in places)
    items.discard(None)
    spans = []
    if ranges:
        ranges = merged(ranges)
        starts, ends = word_places(plain)
        at, chars = 0, 0
        for first, end in ranges:  # bytes become characters, each stretch decoded once
            start, stop = int(starts[first]), int(ends[end - 1])
            begin = chars + len(raw[at:start].decode())
            at, chars = stop, begin + len(raw[start:stop].decode())
            spans.append({"first_word": first, "end_word": end, "start": begin, "end": chars})
    return {
        "n_words": len(words), "n_hit": sum(end - first for first, end in ranges),
        "items": sorted(items), "spans": spans,
    }


def _benchmark_groups(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in groups of about ``max_bytes`` of text, fetched one group at a time."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // max_bytes))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    dealt = F.pmod(F.xxhash64("item", "text"), F.lit(groups))  # by the text too: many items may lack an id
    for group in range(groups):
        part = items.where(dealt == group) if groups > 1 else items
        yield [(r["item"], r["text"]) for r in part.collect()]


def _scanner(spark, items: list[tuple[str | None, str | None]], size: int, carries: bool):
    """A column function over the text, and over the earlier result where ``carries`` is set."""
    shared = spark.sparkContext.broadcast({"items": items})

    def matcher():
        kept = shared.value  # stays in the worker, so the automaton is built once in it
        if "windows" not in kept:
            kept["windows"] = Windows(kept["items"], size)
        return kept["windows"]

    def results(texts: pa.Array, before: pa.Array | None) -> pa.Array:
        earlier = before.to_pylist() if before is not None else [None] * len(texts)
        found = matcher()
        return pa.array(
            [scan((t or "").encode(), found, e) for t, e in zip(texts.to_pylist(), earlier, strict=True)], FOUND
        )

    if carries:
        def first(texts: pa.Array, before: pa.Array) -> pa.Array:
            return results(texts, before)
    else:
        def first(texts: pa.Array) -> pa.Array:
            return results(texts, None)
    return F.arrow_udf(first, FOUND_TYPE)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, max_bytes: int = MAX_BENCHMARK_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans), one row per row of ``docs``.

    ``spans`` are the stretches of hit words with their character places in the original text;
    ``items`` the ids, sorted as text, of the items with occurring windows. A null or empty text has
    no words. An item without an id counts in ``n_hit`` and ``spans`` and is not in ``items``. Repeated
    items or rows and an empty benchmark are fine; other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    for number, items in enumerate(_benchmark_groups(benchmark, max_bytes)):
        if number:
            rows = written(rows, "scanned")
            found = _scanner(docs.sparkSession, items, size, True)("text", "found")
        else:
            found = _scanner(docs.sparkSession, items, size, False)("text")
        rows = rows.select("doc_id", "text", found.alias("found"))
    return rows.select("doc_id", "found.n_words", "found.n_hit", "found.items", "found.spans")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, max_bytes: int = MAX_BENCHMARK_BYTES
) -> DataFrame:
    """The rows of ``docs`` without a hit word, with their own columns; nothing is shuffled.

    Items without an id count like all others.
    """
    for items in _benchmark_groups(benchmark, max_bytes):
        docs = docs.where(_scanner(docs.sparkSession, items, size, False)("text")["n_hit"] == 0)
    return docs
