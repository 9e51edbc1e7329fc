"""Token counts that follow edits.

Every document keeps a segment tree over its pre-tokens: a leaf stands for a run of pre-tokens and
holds their length in characters and their tokens, an inner node the sum below it, the root the
document's count. An edit re-encodes only the leaves it touches, a few characters of context before
them, and as many leaves after it as it takes until the new split meets an old leaf's boundary; the
sums on the paths from these leaves to the root are then updated. All other counts stay.

Why the context suffices: splitting goes from left to right and looks at most ``CONTEXT`` characters
past a pre-token, so a boundary that far before the first edited character stands. Splitting from a
boundary depends only on what follows, so from a boundary that old and new share, all else stands.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF_TOKENS = 32
CONTEXT = 4
# The patterns that are known to look at most CONTEXT characters past a pre-token.
PATTERNS = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])
# Counts of distinct pre-tokens that a worker remembers.
REMEMBERED = 500_000

Edit = tuple[int, int, str]


def checked(pattern: str) -> str:
    """The pattern; an edit would leave wrong boundaries standing under one that looks further ahead."""
    if pattern not in PATTERNS:
        raise ValueError(f"the pattern is not known to look at most {CONTEXT} characters ahead: {pattern}")
    return pattern


class Counter(dict):
    """Tokens of a pre-token, remembered; emptied when it has grown to a bound."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        super().__init__()
        import tiktoken

        self.split = regex.compile(checked(pattern))
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = encoding.encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = count = len(self.encode(piece))
        return count


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary at a path that the driver can read."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def leaves_of(pieces: list[str], counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each run of ``LEAF_TOKENS`` pre-tokens."""
    if not pieces:
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    at = np.arange(0, len(pieces), LEAF_TOKENS)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    tokens = np.fromiter((counter[p] for p in pieces), dtype=np.int64, count=len(pieces))
    return np.add.reduceat(lengths, at), np.add.reduceat(tokens, at)


def tree_of(tokens: np.ndarray) -> np.ndarray:
    """Node 1 is the root, node i has the children 2i and 2i + 1, the leaves are the last half."""
    width = 1 << max(0, int(len(tokens) - 1).bit_length())
    tree = np.zeros(2 * width, dtype=np.int64)
    tree[width : width + len(tokens)] = tokens
    while width > 1:
        half = width // 2
        tree[half:width] = tree[width : 2 * width].reshape(-1, 2).sum(axis=1)
        width = half
    return tree


def clean_edits(edits: list[Edit], length: int) -> list[Edit]:
    """In order, inside the text; of overlapping ones the earlier, then longer, one counts."""
    kept: list[Edit] = []
    for start, end, put in sorted(edits, key=lambda e: (e[0], -e[1], e[2])):
        start, end = max(0, start), min(end, length)
        if start <= end and (not kept or start > kept[-1][1] or (start == kept[-1][1] and start < end)):
            kept.append((start, end, put))
    return kept


def edited(text: str, edits: list[Edit]) -> str:
    parts, at = [], 0
    for start, end, put in edits:
        parts += [text[at:start], put]
        at = end
    return "".join([*parts, text[at:]])


def recount(
    text: str, chars: np.ndarray, tree: np.ndarray, edits: list[Edit], counter: Counter
) -> tuple[str, np.ndarray, np.ndarray, int]:
    """The new text, its leaves and tree, and how many pre-tokens were encoded for them.

    A region that changed keeps its leaves' slots: the first takes all of its characters and tokens.
    """
    edits = clean_edits(edits, len(text))
    new = edited(text, edits)
    bounds = np.concatenate(([0], np.cumsum(chars))).tolist()
    ends = [e[1] for e in edits]
    moved = np.concatenate(([0], np.cumsum([len(p) - (e - s) for s, e, p in edits], dtype=np.int64))).tolist()

    def new_place(old: int) -> int:  # of a place that no edit spans
        return old + moved[bisect_right(ends, old)]

    chars, tree = chars.copy(), tree.copy()
    width, encoded, done, free = len(tree) // 2, 0, 0, 0
    while done < len(edits):
        first = max(free, bisect_right(bounds, edits[done][0] - CONTEXT) - 1, 0)
        # An edit before the context of the first leaves no earlier boundary: the text starts anew.
        begin = 0 if first == 0 else new_place(bounds[first])
        pieces: Iterator[regex.Match] = counter.split.finditer(new, begin)
        tokens, at, last = 0, begin, first
        while True:
            # The next old boundary behind every edit that the region has reached.
            while done < len(edits) and edits[done][0] <= bounds[last]:
                last = max(last, bisect_left(bounds, edits[done][1]))
                done += 1
            if last == len(bounds) - 1:
                target = len(new)
                done = len(edits)
            else:
                target = new_place(bounds[last])
            while at < target:
                piece = next(pieces)
                tokens += counter[piece.group()]
                at = piece.end()
                encoded += 1
            if at == target and last > first:
                break
            last += 1
        width_of = slice(first, last)
        chars[width_of] = 0
        chars[first] = at - begin
        leaves = np.zeros(last - first, dtype=np.int64)
        leaves[0] = tokens
        tree[width + first : width + last] = leaves
        low, high = (width + first) // 2, (width + last - 1) // 2
        while low >= 1:
            tree[low : high + 1] = tree[2 * low : 2 * high + 2].reshape(-1, 2).sum(axis=1)
            low, high = low // 2, high // 2
        free = last
    return new, chars, tree, encoded


TREE_TYPE = "n_tokens long, n_pieces long, chars array<int>, tree array<int>"
_TREE = pa.struct([("n_tokens", pa.int64()), ("n_pieces", pa.int64()), ("chars", pa.list_(pa.int32())),
                   ("tree", pa.list_(pa.int32()))])
EDITS_TYPE = "array<struct<start: int, end: int, put: string>>"


def _kept_counter(shared) -> Counter:
    kept = shared.value  # stays in the worker
    if "counter" not in kept:
        kept["counter"] = Counter(kept["pattern"], kept["ranks"])
    return kept["counter"]


def count_trees(spark: SparkSession, pattern: str, ranks: dict[bytes, int], text: str = "text") -> Column:
    """Column (n_tokens, n_pieces, chars, tree) of a text; null counts as empty.

    Store it beside the text: ``recounted`` needs both. The broadcast is the vocabulary. A pattern that
    is not in ``PATTERNS`` is refused, here and by the other functions.
    """
    shared = spark.sparkContext.broadcast({"pattern": checked(pattern), "ranks": ranks})

    def of(texts: pa.Array) -> pa.Array:
        counter, out = _kept_counter(shared), []
        for text in texts.to_pylist():
            pieces = counter.split.findall(text or "")
            chars, tokens = leaves_of(pieces, counter)
            tree = tree_of(tokens)
            out.append({"n_tokens": int(tree[1]), "n_pieces": len(pieces), "chars": chars, "tree": tree})
        return pa.array(out, _TREE)

    return F.arrow_udf(of, TREE_TYPE)(text)


def recounted(
    spark: SparkSession, pattern: str, ranks: dict[bytes, int], text: str = "text", tree: str = "tree",
    edits: str = "edits",
) -> Column:
    """Column (text, n_tokens, n_encoded, chars, tree) after the edits of a row.

    ``edits`` is an array of (start, end, put) in characters of the old text. Places outside it are
    cut to it, of overlapping edits the first counts, null edits and null parts of one change nothing.
    """
    shared = spark.sparkContext.broadcast({"pattern": checked(pattern), "ranks": ranks})
    kind = pa.struct([("text", pa.string()), ("n_tokens", pa.int64()), ("n_encoded", pa.int64()),
                      ("chars", pa.list_(pa.int32())), ("tree", pa.list_(pa.int32()))])

    def of(texts: pa.Array, trees: pa.Array, changes: pa.Array) -> pa.Array:
        counter, out = _kept_counter(shared), []
        chars_of, tree_of_row = trees.field("chars"), trees.field("tree")
        for row, (text, change) in enumerate(zip(texts.to_pylist(), changes.to_pylist(), strict=True)):
            wanted = [
                (e["start"], e["end"], e["put"])
                for e in change or [] if e and None not in (e["start"], e["end"], e["put"])
            ]
            chars, tree = (np.asarray(x[row].values, dtype=np.int64) for x in (chars_of, tree_of_row))
            new, chars, tree, encoded = recount(text or "", chars, tree, wanted, counter)
            out.append({"text": new, "n_tokens": int(tree[1]), "n_encoded": encoded, "chars": chars, "tree": tree})
        return pa.array(out, kind)

    made = "text string, n_tokens long, n_encoded long, chars array<int>, tree array<int>"
    return F.arrow_udf(of, made)(text, tree, edits)


# Mail addresses and long numbers.
PERSONAL = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d[\d ()-]{5,}\d")
REDACTED = "[redacted]"


def redactions(text: str | None) -> list[dict]:
    """Edits that mask personal data and delete lines that the text has had before."""
    if not text:
        return []
    found = [{"start": m.start(), "end": m.end(), "put": REDACTED} for m in PERSONAL.finditer(text)]
    at, seen = 0, set()
    for line in text.split("\n"):
        end = min(len(text), at + len(line) + 1)
        if line in seen and line:
            found.append({"start": at, "end": end, "put": ""})
        seen.add(line)
        at = end
    return found


def redaction_edits(text: str = "text") -> Column:
    """Column of edits for ``recounted``."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("put", pa.string())]))

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([redactions(t) for t in texts.to_pylist()], kind)

    return F.arrow_udf(of, EDITS_TYPE)(text)


def edited_counts(docs: DataFrame, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, n_pieces, n_edits, after) of every document and its redaction edits.

    ``after`` is the column of ``recounted``. Null and empty texts have no tokens; other columns are
    not read; repeated rows count alike; nothing is shuffled.
    """
    spark = docs.sparkSession
    return (
        docs.select("doc_id", "text", count_trees(spark, pattern, ranks).alias("tree"), redaction_edits().alias("edits"))
        .select(
            "doc_id", "tree.n_tokens", "tree.n_pieces", F.size("edits").alias("n_edits"),
            recounted(spark, pattern, ranks).alias("after"),
        )
    )
