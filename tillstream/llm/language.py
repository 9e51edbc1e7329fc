"""Language identification by a small convolutional network over bytes.

A window of fixed length goes through byte embeddings, filters of several widths, a rectifier, a
maximum over all places and a softmax. It is trained in numpy on a bounded sample of labelled
documents. For use, embeddings and filters are folded into one table per place of a filter, so that
a convolution is a few table look-ups and sums; whole texts are cut into windows and scored in Arrow
batches, and a document's language has the highest mean log probability over its windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.llm.common import share_of

PARTS, HELD_OUT = 3, 1
UNKNOWN = "und"
WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
# Bounds of the training sample: documents of each language and of all, windows of each document. Where
# languages are so many that the second bound counts, each has an equal part of it, and one at least.
SAMPLE_DOCUMENTS = 1_500
ALL_DOCUMENTS = 384_000
SAMPLE_WINDOWS = 3
EPOCHS, BATCH, RATE = 3, 64, 4e-3
# Windows scored at once: their activations stay in the processor's cache.
_AT_ONCE = 64


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text in rows of ``size`` bytes, the last one filled up with zeros."""
    rows = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(rows * size, b"\0"), dtype=np.uint8).reshape(rows, size)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    tables: np.ndarray  # (place, byte, filter)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """The rectified maximum of every filter, per window."""
        span = ids.shape[1] - len(self.tables) + 1
        values = self.tables[0][ids[:, :span]]
        for place in range(1, len(self.tables)):
            values += self.tables[place][ids[:, place : place + span]]
        return np.maximum(values.max(axis=1) + self.bias, 0.0)

    def logits(self, ids: np.ndarray) -> np.ndarray:
        parts = [self.pooled(ids[i : i + _AT_ONCE]) for i in range(0, len(ids), _AT_ONCE)]
        return np.concatenate(parts) @ self.dense + self.dense_bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; unknown with 0 where the text has no letter."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        logits = self.logits(windows(text.encode()))
        logs = (logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)).mean(axis=0)
        p = _softmax(logs[None, :])[0]
        return self.languages[int(p.argmax())], float(p.max())


def fit(texts: list[str], languages: list[str], seed: int = 5) -> LanguageModel:
    """Cross-entropy by Adam steps over shuffled windows. No rows give a model without languages."""
    rng = np.random.default_rng(seed)
    names = tuple(sorted(set(languages)))
    parts = [windows(t.encode()) for t in texts]
    ids = np.concatenate(parts) if parts else np.zeros((0, WINDOW), dtype=np.uint8)
    number = {name: i for i, name in enumerate(names)}
    labels = np.repeat([number[x] for x in languages], [len(p) for p in parts]) if parts else np.zeros(0, int)

    widths = np.repeat(WIDTHS, FILTERS)
    used = (np.arange(max(WIDTHS))[:, None] < widths[None, :]).astype(np.float32)[:, None, :]
    shapes = {
        "embedding": (256, EMBEDDING), "filters": (max(WIDTHS), EMBEDDING, len(widths)), "bias": (len(widths),),
        "dense": (len(widths), len(names)), "dense_bias": (len(names),),
    }
    spread = {"embedding": 0.5, "filters": 0.3, "dense": 0.3}
    net = {k: (rng.standard_normal(s) * spread.get(k, 0.0)).astype(np.float32) for k, s in shapes.items()}
    net["filters"] *= used
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}

    def tables() -> np.ndarray:
        return np.einsum("be,pef->pbf", net["embedding"], net["filters"]).astype(np.float32)

    span, step = WINDOW - max(WIDTHS) + 1, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            batch, wanted = ids[chosen], labels[chosen]
            folded = tables()
            values = sum(folded[p][batch[:, p : p + span]] for p in range(len(folded)))
            best = values.argmax(axis=1)
            peak = np.take_along_axis(values, best[:, None, :], axis=1)[:, 0] + net["bias"]
            pooled = np.maximum(peak, 0.0)
            slope = _softmax(pooled @ net["dense"] + net["dense_bias"])
            slope[np.arange(len(wanted)), wanted] -= 1.0
            slope /= len(wanted)
            to_peak = (slope @ net["dense"].T) * (peak > 0)
            # Only the bytes under each filter's best place get a gradient.
            by_byte = np.zeros_like(folded)
            row, column = np.arange(len(batch))[:, None], np.arange(len(widths))[None, :]
            for p in range(len(folded)):
                np.add.at(by_byte[p], (batch[row, best + p], column), to_peak)
            gradient = {
                "embedding": np.einsum("pbf,pef->be", by_byte, net["filters"]),
                "filters": np.einsum("pbf,be->pef", by_byte, net["embedding"]) * used,
                "bias": to_peak.sum(axis=0), "dense": pooled.T @ slope, "dense_bias": slope.sum(axis=0),
            }
            step += 1
            for k, g in gradient.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return LanguageModel(names, tables(), net["bias"], net["dense"], net["dense_bias"])


def training_rows(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, most: int = ALL_DOCUMENTS) -> DataFrame:
    """(text, lang): pieces of at most about ``documents`` documents of each language, ``most`` of all.

    Documents are chosen by a hash of their id, at a rate that depends on the language's count; the
    one with the smallest hash of a language is always chosen, so no language is left out. Of a
    chosen document three pieces of a window's length are taken: first, middle and last.
    """
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    usable = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (share_of(F.col("doc_id"), PARTS) != HELD_OUT)
    ).select("doc_id", "lang", "text", unit.alias("unit"))
    share = F.lit(float(most)) / F.count("*").over(Window.partitionBy())  # sees a row per language
    rate = F.least(F.lit(float(documents)), share) / F.col("rows")
    rates = (
        usable.groupBy("lang").agg(F.count("*").alias("rows"), F.min("unit").alias("smallest"))
        .select(F.col("lang").alias("known"), "smallest", rate.alias("rate"))
    )
    wanted = (F.col("unit") < F.col("rate")) | (F.col("unit") == F.col("smallest"))
    chosen = usable.join(F.broadcast(rates), (F.col("lang") == F.col("known")) & wanted)
    length = F.length("text")
    starts = [F.lit(1), F.floor(length / 2).cast("int") + 1, F.greatest(F.lit(1), length - WINDOW + 1)]
    pieces = F.array_distinct(F.array(*[F.col("text").substr(s, F.lit(WINDOW)) for s in starts[:SAMPLE_WINDOWS]]))
    return (
        chosen.orderBy(F.col("unit") > F.col("smallest"), F.xxhash64("doc_id"), "doc_id").limit(2 * most)
        .select("lang", F.explode(pieces).alias("text"))
    )


def trained(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, most: int = ALL_DOCUMENTS) -> LanguageModel:
    """The network of all values of lang outside the held-out share."""
    rows = training_rows(docs, documents, most).toArrow()
    pairs = sorted(
        (t, x) for t, x in zip(rows["text"].to_pylist(), rows["lang"].to_pylist(), strict=True)
        if any(map(str.isalpha, t))
    )
    return fit([t for t, _ in pairs], [x for _, x in pairs])


def predictor(spark: SparkSession, model: LanguageModel, text: str = "text"):
    """Column (lang_pred, score) of a text; the broadcast is the network, under 1 MB
    for up to some thousand languages."""
    shared = spark.sparkContext.broadcast(
        (model.languages, model.tables, model.bias, model.dense, model.dense_bias)
    )
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def of(texts: pa.Array) -> pa.Array:
        network = LanguageModel(*shared.value)
        found = [network.predict(t) for t in texts.to_pylist()]
        return pa.array([{"lang_pred": a, "score": b} for a, b in found], kind)

    return F.arrow_udf(of, "lang_pred string, score double")(text)


def languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score), one row per row of ``docs``.

    Null texts and texts without a letter are unknown with score 0, and so is every text where no
    labelled row was there to learn from. Ties go to the first language by name. Repeated rows are
    predicted alike; other columns are not read.
    """
    found = docs.select("doc_id", predictor(docs.sparkSession, model).alias("found"))
    return found.select("doc_id", "found.*")
