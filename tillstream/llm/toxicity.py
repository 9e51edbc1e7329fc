"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from its words; a document is
toxic if any sentence is, so its probability is the noisy-or of its sentences:

    P(document) = 1 - product(1 - p(sentence)) = 1 - exp(-sum(softplus(z(sentence))))

Only documents carry labels. The gradient of the document's loss reaches every sentence through the
noisy-or, so the words of offending sentences gain weight and the sentences can then be pointed out.

After the fit a sentence without any such word still scores about 0.001, which adds up in a long clean
text. So the sentences' scores are made steeper about the threshold: one that lies there keeps its
score, and what is far below it no longer adds up.

The model is fitted in numpy on a bounded sample of labelled rows; scoring reads whole texts in
Arrow batches and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm.common import labelled_sample

# The bound of the training sample: rows, and bytes of all their texts.
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 64_000_000
# Share of the ids that is held out: crc32(doc_id) modulo PARTS.
PARTS, HELD_OUT = 3, 1
THRESHOLD = 0.7
# A feature counts if it is in so many sampled documents and its share among toxic ones stands out by
# so many standard errors; at most so many are kept.
LEAST_DOCUMENTS = 5
LEAST_CONTRAST = 4.0
MOST_FEATURES = 20_000
# Features of a word: itself and its first letters, which inflected forms share.
PREFIXES = (4, 5)
STEPS = 200
LEARNING_RATE = 0.1
PENALTY = 1e-4
# How many times steeper the sentences' scores become, about the threshold.
SHARPNESS = 4.0

# A word of letters, or the end of a sentence.
TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


@dataclass(frozen=True)
class ToxicityModel:
    """Weight of each feature and of a sentence as such. Features without a weight count as zero."""

    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(feature, 0.0) for feature in features_of(word))


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def numbered(texts: Iterable[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """The distinct words, and per text the numbers of its words and of their sentences.

    Texts are taken one at a time, so no more than one is held as strings.
    """
    numbers: dict[str, int] = {}
    words, sentences = [], []
    for text in texts:
        found, places, place, begun = [], [], 0, False
        for token in TOKENS.findall(text.lower()):
            if token in _ENDS:
                place, begun = place + begun, False
            else:
                found.append(numbers.setdefault(token, len(numbers)))
                places.append(place)
                begun = True
        words.append(np.array(found, dtype=np.int32))
        sentences.append(np.array(places, dtype=np.int32))
    return list(numbers), words, sentences


def _lists(starts: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists that ``rows`` name, one after the other, and the length of each."""
    lengths = starts[rows + 1] - starts[rows]
    offset = np.repeat(starts[rows] - (np.cumsum(lengths) - lengths), lengths)
    return values[offset + np.arange(len(offset))], lengths


def selected(words: list[str], documents: list[np.ndarray], labels: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Features whose share of documents differs between the labels beyond chance, and the lists of
    them that each word has (starts, values)."""
    known: dict[str, int] = {}
    lists = [[known.setdefault(f, len(known)) for f in features_of(w)] for w in words]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    values = np.array([f for x in lists for f in x], dtype=np.int64)
    spread = np.zeros((2, len(known)))
    for document, label in zip(documents, labels, strict=True):
        spread[int(label), np.unique(_lists(starts, values, np.unique(document))[0])] += 1
    clean, toxic = spread
    sizes = [max(1, int((labels == k).sum())) for k in (0, 1)]
    pooled = (clean + toxic + 1) / (sizes[0] + sizes[1] + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / sizes[0] + 1 / sizes[1]))
    contrast = np.abs(toxic / sizes[1] - clean / sizes[0]) / error
    wanted = np.flatnonzero((clean + toxic >= LEAST_DOCUMENTS) & (contrast >= LEAST_CONTRAST))
    names = list(known)
    chosen = sorted(wanted.tolist(), key=lambda f: (-contrast[f], names[f]))[:MOST_FEATURES]
    place = np.full(len(names), -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    kept = place[values] >= 0
    counts = np.concatenate(([0], np.cumsum(kept)))
    return [names[f] for f in chosen], counts[starts], place[values][kept]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit(texts: Iterable[str], labels: np.ndarray) -> ToxicityModel:
    """Noisy-or likelihood of the document labels, by full-batch Adam steps with a penalty on weights.

    Without both labels in the sample every document scores the share of label 1 (0 for no rows).
    """
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel({}, 40.0 if len(labels) and labels[0] else -40.0)
    words, documents_words, places = numbered(texts)
    chosen, starts, values = selected(words, documents_words, labels)
    documents = len(documents_words)
    sizes = np.array([int(p[-1]) + 1 if len(p) else 0 for p in places])
    sentences = int(sizes.sum())
    sentence_doc = np.repeat(np.arange(documents), sizes)
    first = np.cumsum(sizes) - sizes
    token_sentence = np.concatenate([p + f for p, f in zip(places, first, strict=True)])
    features, lengths = _lists(starts, values, np.concatenate(documents_words))
    at_sentence = np.repeat(token_sentence, lengths)

    weights, bias = np.zeros(len(chosen)), -4.0
    state = [np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)]
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(at_sentence, weights[features], minlength=sentences)
        total = np.maximum(np.bincount(sentence_doc, _softplus(z), minlength=documents), 1e-12)
        # d loss / d total: 1 for label 0, -1 / (exp(total) - 1) for label 1.
        slope = np.where(labels > 0, -1.0 / np.expm1(np.minimum(total, 50.0)), 1.0) / documents
        by_sentence = slope[sentence_doc] * _sigmoid(z)
        gradient = np.append(
            np.bincount(features, by_sentence[at_sentence], minlength=len(chosen)) + PENALTY * weights / documents,
            by_sentence.sum(),
        )
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = LEARNING_RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    weights, bias = SHARPNESS * weights, SHARPNESS * bias + (1 - SHARPNESS) * np.log(THRESHOLD / (1 - THRESHOLD))
    return ToxicityModel({w: float(v) for w, v in zip(chosen, weights, strict=True)}, float(bias))


def trained(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES
) -> ToxicityModel:
    """The model of the labelled rows outside the held-out share, from a sample bounded in rows and bytes."""
    rows = labelled_sample(docs, labels, "toxic", PARTS, HELD_OUT, sample_rows, sample_bytes).toArrow()
    return fit((text.as_py() for text in rows["text"]), rows["label"].to_numpy())


class WordScores(dict):
    """Scores of the words met so far; emptied when it has grown to a bound."""

    def __init__(self, model: ToxicityModel, most: int = 500_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = score = self.model.word(word)
        return score


def score_text(text: str | None, known: WordScores) -> tuple[float, np.ndarray]:
    """Probability of the document, and the softplus of each of its sentences."""
    if not text:
        return 0.0, np.zeros(0)
    ends = _ENDS
    tokens = TOKENS.findall(text.lower())
    marks = np.fromiter((t in ends for t in tokens), dtype=bool, count=len(tokens))
    values = np.fromiter(map(known.__getitem__, tokens), dtype=np.float64, count=len(tokens))
    place = np.cumsum(marks)[~marks]
    if not len(place):
        return 0.0, np.zeros(0)
    words = np.bincount(place)
    sums = np.bincount(place, values[~marks])
    each = np.where(words > 0, _softplus(known.model.bias + sums), 0.0)
    return float(-np.expm1(-each.sum())), each


def worst_sentence(text: str, each: np.ndarray) -> tuple[int, int, float]:
    """Character places of the sentence with the highest score, and that score."""
    worst = int(each.argmax())
    ends = [m.end() for m in re.finditer(r"[.!?\n]", text)]
    bounds = [0, *ends, len(text)]
    return bounds[worst], bounds[worst + 1], float(-np.expm1(-each[worst]))


SCORED = pa.struct(
    [("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("sentence_score", pa.float64())]
)


def scorer(spark: SparkSession, model: ToxicityModel, text: str = "text") -> Column:
    """Column (score, start, end, sentence_score): the document and its worst sentence.

    The place is null below the threshold. The broadcast has at most ``MOST_FEATURES`` weights.
    """
    shared = spark.sparkContext.broadcast({"weights": model.weights, "bias": model.bias})

    def one(value: str | None) -> dict:
        kept = shared.value  # stays in the worker
        if "known" not in kept:
            kept["known"] = WordScores(ToxicityModel(kept["weights"], kept["bias"]))
        score, each = score_text(value, kept["known"])
        found = {"score": score, "start": None, "end": None, "sentence_score": None}
        if score >= THRESHOLD:
            found["start"], found["end"], found["sentence_score"] = worst_sentence(value, each)
        return found

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], SCORED)

    return F.arrow_udf(scored, "score double, start int, end int, sentence_score double")(text)


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, start, end, sentence_score), one row per row of ``docs``.

    Null, empty and wordless texts score 0. Other columns are not read; repeated rows score alike.
    """
    scored = docs.select("doc_id", scorer(docs.sparkSession, model).alias("scored"))
    return scored.select("doc_id", "scored.*")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    return docs.where(scorer(docs.sparkSession, model)["score"] < threshold)
