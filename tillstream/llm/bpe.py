"""BPE encoding and decoding of whole texts over a table of distinct words.

A word's tokens do not depend on its neighbours, so each distinct word is encoded once:

1. Texts are split into words and counted in Arrow batches. A batch hands on the words that it has
   ``LEAST_IN_BATCH`` times, so the counts, too low by less than that per batch, shuffle little. The most
   frequent words, at most ``HOT_WORDS``, are the first part of the distinct-word table and broadcast.
2. Texts are taken in blocks of ``BLOCK_TEXTS``. A block becomes one sequence of its hot words' numbers, with a
   gap for every other word, packed as a whole. The blocks are dealt out once; both steps below read
   that one shuffle.
3. The gaps' words are dealt out by word. Their distinct ones are the second part of the table; the
   gaps join it where they lie, and their tokens go back to their block by key and place. None of
   these words is frequent, so the join has no hot key.
4. Decoding joins every id with its piece: the vocabulary is small and broadcast as an array, and an id is the
   piece's place in it, so this map-side join is a lookup by position.

Which words are hot changes the path of a word, never its tokens.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstream.session import written

# At most so many words are broadcast with their ids.
HOT_WORDS = 524_288
# Texts of a block, and the characters at which a block ends before it has so many.
BLOCK_TEXTS = 64
BLOCK_CHARS = 1 << 20
# A batch counts every word and hands on those that it has so often.
LEAST_IN_BATCH = 3
# Steps of counts for each doubling.
_COUNT_STEPS = 4

# The normaliser and the pre-tokeniser that this operator implements; others are refused.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Latin letters, digits and common punctuation: characters whose kinds never change, and texts that
# are their own normal form. Such texts, nearly all of most corpora, are split by a plain pattern.
_LATIN = re.compile("[\x00-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ſ‐-‧‰-‾€]*")
_LETTERS = "a-z\xdf-\xf6\xf8-ſ"
_LATIN_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[^\t-\r \x85\xa0{_LETTERS}0-9]+")


class Splitter:
    """The words of a text in order; a special token is a word of its own and never another's part."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.library = vocabulary, None
        longest_first = sorted(vocabulary.special_ids, key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None

    def plain(self, text: str) -> list[str]:
        if _LATIN.fullmatch(text):
            return _LATIN_WORDS.findall(text.lower())
        # What is a letter elsewhere depends on the version of Unicode: the library's own steps decide.
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.vocabulary.text)
        text = self.library.normalizer.normalize_str(text)
        return [text[start:end] for _, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        words: list[str] = []
        for number, part in enumerate(self.specials.split(text)):
            words += [part] if number % 2 else self.plain(part)
        return words


def _byte_characters() -> list[str]:
    """One printable character for each byte: itself, or the next free one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    places = {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}
    return [chr(places[b]) for b in range(256)]


class Vocabulary:
    """A vocabulary file's text, checked for the kinds of steps that this operator implements."""

    def __init__(self, text: str):
        found = json.loads(text)
        normalizers = [n["type"] for n in found["normalizer"]["normalizers"]]
        split, mapped = found["pre_tokenizer"]["pretokenizers"]
        added = found["added_tokens"]
        if (
            normalizers != _NORMALIZERS or split["pattern"].get("Regex") != _SPLIT or not split["invert"]
            or mapped["type"] != "ByteLevel" or mapped["use_regex"] or mapped["add_prefix_space"]
            or found["decoder"] is not None
            or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        ):
            raise ValueError("the vocabulary's normaliser, pre-tokeniser, decoder or special tokens are of another kind")
        self.text = text
        self.special_ids = {t["content"]: t["id"] for t in added}
        self.pieces = {i: p for p, i in found["model"]["vocab"].items()} | {t["id"]: t["content"] for t in added}

    def encoder(self) -> Callable[[str], list[int]]:
        """Ids of one word."""
        from tokenizers import Tokenizer

        model, characters, specials = Tokenizer.from_str(self.text).model, _byte_characters(), self.special_ids

        def encode(word: str) -> list[int]:
            if word in specials:
                return [specials[word]]
            return [t.id for t in model.tokenize("".join(characters[b] for b in word.encode()))]

        return encode


@functools.cache
def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary at a path that the driver can read; executors get its text by broadcast."""
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def _word_counts(docs: DataFrame, shared) -> DataFrame:
    """(word, rows): the words that some batch has often, with a lower bound of their counts; stored."""
    least = LEAST_IN_BATCH

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value  # stays in the worker
        if "splitter" not in kept:
            kept["splitter"] = Splitter(Vocabulary(kept["vocabulary"]))
        words_of = kept["splitter"]
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
            often = [(w, n) for w, n in counts.items() if n >= least]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())],
                ["word", "rows"],
            )

    counted = docs.select("text").mapInArrow(count, "word string, rows long")
    return written(counted.groupBy("word").agg(F.sum("rows").alias("rows")), "word-counts")


def encoded_words(words: DataFrame, shared, kind: str) -> DataFrame:
    """(word, ids) of distinct words, a word's ids as bytes of numbers of the ``kind``."""

    def encode(found: pa.Array) -> pa.Array:
        kept = shared.value  # stays in the worker
        if "encoder" not in kept:
            kept["encoder"] = Vocabulary(kept["vocabulary"]).encoder()
        encoder = kept["encoder"]
        return pa.array([np.array(encoder(w), dtype=kind).tobytes() for w in found.to_pylist()], pa.binary())

    return words.withColumn("ids", F.arrow_udf(encode, "binary")("word"))


def hot_words(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``.

    Counts are told apart by steps, ``_COUNT_STEPS`` for each doubling; their histogram is small, and
    whole steps are taken while they fit.
    """
    stepped = words.withColumn("step", F.floor(F.log2("rows") * _COUNT_STEPS).cast("int"))
    taken, first = 0, 1 << 30
    for row in sorted(stepped.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        taken += row["count"]
        if taken > most:
            break
        first = row["step"]
    return stepped.where(F.col("step") >= first).drop("step")


class Numbers(dict):
    """Numbers of the hot words; 0 for any other."""

    def __missing__(self, word: str) -> int:
        return 0


def _squeezed(data: bytes, strategy: int = zlib.Z_HUFFMAN_ONLY) -> bytes:
    squeezer = zlib.compressobj(1, zlib.DEFLATED, -15, 9, strategy)
    return squeezer.compress(data) + squeezer.flush()


def packed(numbers: np.ndarray, gaps: list[str]) -> bytes:
    """Numbers below 2 ** 24, byte plane by byte plane, and the words of the gaps, which hold no space."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    parts = [_squeezed(p.tobytes()) for p in planes] + [_squeezed("\n".join(gaps).encode(), zlib.Z_DEFAULT_STRATEGY)]
    return struct.pack("<4I", *map(len, parts)) + b"".join(parts)


def _parts(data: bytes, wanted: range) -> list[bytes]:
    ends = np.cumsum([16, *struct.unpack("<4I", data[:16])]).tolist()
    return [zlib.decompress(data[ends[i] : ends[i + 1]], -15) for i in wanted]


def packed_numbers(data: bytes) -> np.ndarray:
    low, middle, high = (np.frombuffer(p, dtype=np.uint8).astype(np.int64) for p in _parts(data, range(3)))
    return low + (middle << 8) + (high << 16)


def packed_gaps(data: bytes) -> list[str]:
    words = _parts(data, range(3, 4))[0].decode()
    return words.split("\n") if words else []


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Places where the blocks of a batch begin and end; a long text ends its block."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    start = chars = 0
    for at, length in enumerate(lengths, 1):
        chars += length
        if at - start == BLOCK_TEXTS or chars >= BLOCK_CHARS or at == len(lengths):
            yield start, at
            start, chars = at, 0


def _decoder(context: SparkContext, vocabulary: Vocabulary) -> Callable[[pa.Array], pa.Array]:
    """The pieces of id lists, joined by spaces; special tokens are kept.

    The pieces are broadcast: they are as many as the vocabulary has. Ids outside it have no piece.
    """
    most = max(vocabulary.pieces)
    shared = context.broadcast(pa.array([vocabulary.pieces.get(i) for i in range(most + 1)], pa.string()))

    def decode(lists: pa.Array) -> pa.Array:
        lists = pc.fill_null(lists, pa.scalar([], lists.type))
        values = lists.flatten()
        known = pc.and_(pc.greater_equal(values, 0), pc.less_equal(values, most))
        found = shared.value.take(pc.if_else(known, values, pa.scalar(None, values.type)))
        counts = np.asarray(pc.list_value_length(lists)).astype(np.int32)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        if found.null_count:
            owners = np.repeat(np.arange(len(lists)), counts)[np.asarray(found.is_valid())]
            counts = np.bincount(owners, minlength=len(lists))
            offsets, found = np.concatenate(([0], np.cumsum(counts))).astype(np.int32), found.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), found), " ")

    return decode


def decoded(spark: SparkSession, vocabulary: Vocabulary, ids: str = "ids") -> Column:
    """Column of the pieces of an id list, joined by spaces, for ids that are stored."""
    return F.arrow_udf(_decoder(spark.sparkContext, vocabulary), "string")(ids)


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, hot: int = HOT_WORDS) -> DataFrame:
    """(doc_id, ids, decoded), one row per row of ``docs``: the tokens of every whole text, and their pieces.

    Null and empty texts have no tokens. Rows repeated in full are encoded alike. Ids may be of any type and
    null. Only ``doc_id`` and ``text`` are read, so other columns cannot clash; an empty table gives no
    rows. ``docs`` is read from storage, so that a task that runs again makes the same blocks.
    """
    context = docs.sparkSession.sparkContext
    library = context.broadcast({"vocabulary": vocabulary.text})
    kind = "<u2" if max(vocabulary.pieces) < 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    frequent = encoded_words(hot_words(_word_counts(docs, library), min(hot, HOT_WORDS)), library, kind).toArrow()
    order = np.lexsort((frequent["word"].to_numpy(), -frequent["rows"].to_numpy()))
    words, ids = frequent["word"].take(order).to_pylist(), frequent["ids"].take(order).to_pylist()
    frequent_words = context.broadcast({"vocabulary": vocabulary.text, "words": words})
    shared = context.broadcast(
        {
            # Number 0 is the gap.
            "starts": np.concatenate(([0, 0], np.cumsum([len(i) // width for i in ids], dtype=np.int64))).astype(np.int64),
            "ids": np.frombuffer(b"".join(ids), dtype=kind).astype(np.int32),
        }
    )
    decode = _decoder(context, vocabulary)
    id_type = docs.schema["doc_id"].dataType

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = frequent_words.value  # stays in the worker
        if "numbers" not in kept:
            words = kept.pop("words")
            kept["numbers"] = Numbers(zip(words, range(1, len(words) + 1), strict=True))
            kept["splitter"] = Splitter(Vocabulary(kept["vocabulary"]))
        number_of, words_of = kept["numbers"].__getitem__, kept["splitter"]
        block = TaskContext.get().partitionId() << 32  # the task's first number
        for batch in batches:
            doc_ids, texts = batch.columns
            for start, end in _blocks(texts):
                found, counts = [], []
                for text in texts[start:end]:
                    words = words_of(text.as_py())
                    found += words
                    counts.append(len(words))
                numbers = np.fromiter(map(number_of, found), dtype="<u4", count=len(found))
                sequence = packed(numbers, [found[i] for i in np.flatnonzero(numbers == 0)])
                ends = pa.array([0, end - start], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.ListArray.from_arrays(ends, doc_ids[start:end]),
                        pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                        pa.array([sequence], pa.binary()),
                    ],
                    ["block", "doc_ids", "counts", "sequence"],
                )
                block += 1

    def gaps_of(sequences: pa.Array, *_: pa.Array) -> pa.Array:
        return pa.array([packed_gaps(s) for s in sequences.to_pylist()], pa.list_(pa.string()))

    def tokens_of(sequence: bytes, filled: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a block, and how many each of its words has."""
        starts, base = shared.value["starts"], shared.value["ids"]
        lengths = np.diff(starts, append=len(base))
        lengths[0] = 0
        numbers = packed_numbers(sequence)
        begin, count = starts[numbers], lengths[numbers]
        own = np.zeros(0, dtype=np.int32)
        if filled is not None and len(filled):
            found = filled.field("ids").take(pa.array(np.argsort(np.asarray(filled.field("place")))))
            sizes = np.asarray(pc.binary_length(found)).astype(np.int64) // width
            at = np.flatnonzero(numbers == 0)
            begin[at] = len(base) + np.cumsum(sizes) - sizes
            count[at] = sizes
            own = np.frombuffer(b"".join(found.to_pylist()), dtype=kind).astype(np.int32)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(begin - (ends - count), count) + np.arange(total)
        tokens = np.empty(total, dtype=np.int32)
        inside = places < len(base)
        tokens[inside] = base[places[inside]]
        tokens[~inside] = own[places[~inside] - len(base)]
        return tokens, count

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, counts, sequence, filled in zip(*batch.columns, strict=True):
                tokens, per_word = tokens_of(sequence.as_py(), filled.values)
                word_ends = np.concatenate(([0], np.cumsum(np.asarray(counts.values))))
                ends = np.concatenate(([0], np.cumsum(per_word)))[word_ends].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_ids.values, lists, decode(lists)], ["doc_id", "ids", "decoded"])

    # All readers of the dealt blocks take all their columns, so they read one shuffle and the texts are
    # split once.
    schema = (
        T.StructType().add("block", "long", False).add("doc_ids", T.ArrayType(id_type))
        .add("counts", T.ArrayType(T.IntegerType())).add("sequence", "binary")
    )
    blocks = docs.select("doc_id", "text").mapInArrow(number, schema).repartition("block")
    words_of_gaps = F.arrow_udf(gaps_of, "array<string>")("sequence", "doc_ids", "counts")
    gaps = blocks.select("block", F.posexplode(words_of_gaps).alias("place", "word"))
    table = encoded_words(gaps.groupBy("word").agg(F.count("*").alias("rows")), library, kind).drop("rows")
    # Dealt out as plain rows: a block's words lie in as many tasks, so lists made there are longer.
    filled = gaps.join(table, "word").select("block", "place", "ids").repartition("block").groupBy("block").agg(
        F.collect_list(F.struct("place", "ids")).alias("filled")  # the words of one block, which was one row before
    )
    joined = blocks.join(filled.hint("shuffle_hash"), "block", "left")
    result = T.StructType().add("doc_id", id_type).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return joined.select("doc_ids", "counts", "sequence", "filled").mapInArrow(assemble, result)


def encode(docs: DataFrame, vocabulary: Vocabulary, hot: int = HOT_WORDS) -> DataFrame:
    """(doc_id, ids), one row per row of ``docs``."""
    return encode_decode(docs, vocabulary, hot).drop("decoded")
