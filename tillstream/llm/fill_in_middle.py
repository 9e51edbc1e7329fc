"""Fill-in-middle transformation, with cuts found by rank in an indexable skip list.

A text is a list of units: runs of letters A to Z, and single other characters. Lane 0 of the list has
a node for each unit; a node of an express lane stands for a random run of nodes of the lane below. All
nodes carry two widths, in units and in code points. A descent from the highest lane adds up the
widths of the nodes that it passes while they end at or before the wanted rank, so it reaches the cut
exactly, and knows its code points, after some four steps a lane.

The lists live in Arrow batches and return three numbers for each text; prefixes, middles and suffixes are
then cut and put together by SQL functions. No row meets another, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the transformation.
VERSION = 1
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Of so many nodes about one is on the next lane.
_FAN = 4
_CUTS = "n long, prefix_chars long, middle_chars long"


def unit_widths(data: np.ndarray) -> np.ndarray:
    """Code points of each unit ``[A-Za-z]+|[^A-Za-z]`` of a text's UTF-8 bytes."""
    letter = (data | 0x20) - np.uint8(97) < 26
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    at = np.flatnonzero(begins)
    # A run of letters has a byte for each code point, any other unit is one code point.
    return np.where(letter[at], np.diff(at, append=len(data)), 1)


class SkipList:
    """Units in order, found by rank. Where the express lanes stop depends on ``random``, what they find does not."""

    def __init__(self, widths: np.ndarray, random: np.random.Generator):
        self.lanes = [(np.ones(len(widths), dtype=np.int64), widths.astype(np.int64), None)]
        heights = random.geometric(1 - 1 / _FAN, len(widths))
        while len(heights) > _FAN:
            units, chars, _ = self.lanes[-1]
            taller = heights > len(self.lanes)
            taller[0] = True  # the head is on every lane
            first = np.flatnonzero(taller)
            if len(first) == len(heights):
                break
            below = np.append(first, len(heights))
            self.lanes.append((np.add.reduceat(units, first), np.add.reduceat(chars, first), below))
            heights = heights[first]

    def __len__(self) -> int:
        return len(self.lanes[0][0])

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not 0 <= rank <= len(self):
            raise IndexError(rank)
        node = passed = chars = 0
        for units, widths, below in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                chars += int(widths[node])
                node += 1
            if below is not None:
                node = int(below[node])  # where the node's run begins; behind the last node, the lower lane's end
        return chars


def cut_places(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Units of each text, and code points of its prefix and middle under two random numbers."""
    random = np.random.default_rng(0)
    made = []
    for text, one, two in zip(texts, first.to_pylist(), second.to_pylist(), strict=True):
        units = SkipList(unit_widths(np.frombuffer(text.as_buffer(), dtype=np.uint8)), random)
        n = len(units)
        low, high = sorted((one % (n + 1), two % (n + 1)))
        before = units.chars_before(low)
        made.append((n, before, units.chars_before(high) - before))
    columns = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)] or [pa.array([], pa.int64())] * 3
    return pa.StructArray.from_arrays(columns, [c.split()[0] for c in _CUTS.split(", ")])


def _random_numbers(doc_id: str) -> list[Column]:
    """Four numbers below 2 ** 32 that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{VERSION}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    ``form`` is plain where the text is empty, holds one of the three marks, or the id's number keeps
    it whole; else spm or psm. A null text is empty, a null id counts as an id of no digits. Rows repeated
    in full are treated alike. Only ``doc_id`` and ``text`` are read, so other columns cannot clash; an empty
    table gives no rows.
    """
    h1, h2, h3, h4 = _random_numbers("doc_id")
    marks = [F.contains("text", F.lit(mark)) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | marks[0] | marks[1] | marks[2] | (h3 % 100 >= CUT_PERCENT)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", form.alias("form"), F.arrow_udf(cut_places, _CUTS)("text", h1, h2).alias("cut")
    ).select("doc_id", "text", "form", "cut.*")

    before, inside = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix = F.substr("text", F.lit(1), before)
    middle = F.substr("text", before + 1, inside)
    suffix = F.substr("text", before + inside + 1)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    whole = F.col("form") == "plain"
    return cut.select(
        "doc_id", "n", "form",
        *[F.when(~whole, F.col(name)).alias(name) for name in ("prefix_chars", "middle_chars")],
        output.alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that a transformed one was made of, from nothing but the output and its form."""
    whole = F.col(output)
    body = F.substr(whole, F.lit(len(PREFIX) + 1))

    def parts(mark: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(body, mark, 1)
        rest = F.substr(body, F.length(first) + len(mark) + 1)
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substr(rest, F.length(second) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(SUFFIX)
    other_suffix, other_prefix, other_middle = parts(PREFIX)
    return (
        F.when(F.col(form) == "plain", whole)
        .when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(other_prefix, other_middle, other_suffix))
    )
