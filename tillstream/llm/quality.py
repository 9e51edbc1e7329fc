"""Text quality by a regularised quadratic discriminant.

Every text becomes a vector of transformed statistics. Each class has a mean and a covariance that
is shrunk towards the pooled one and towards a sphere; the score is the difference of the classes'
Gaussian log densities, with Mahalanobis lengths from Cholesky factors that are computed once. One
logistic curve over that margin turns it into a probability.

The moments of the classes are sums, added up in Spark over all labelled rows outside the held-out
share; only they and a histogram of margins reach the driver, and their size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.common import share_of
from tillstream.session import written

PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.7
# Weight of the pooled covariance, then of the sphere, in the covariance of a class.
TO_POOLED, TO_SPHERE = 0.1, 0.05
# The histogram of margins for the logistic curve: bins over a range of squeezed margins.
BINS, SQUEEZED = 480, 12.0

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:!?'\"-",
    "bar": b"|\t",
    "bracket": b"<>[]{}()/\\=_@",
    "symbol": b"#$%&*+^~`",
    "space": b" \r\x0b\x0c",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
_TABLE = np.array([[b in group for group in _GROUPS.values()] for b in range(256)], dtype=np.float64)
STATISTICS = (
    "bytes", "words", *_GROUPS, "word_length", "long_words", "distinct_words", "repeated_lines", "line_words",
    "plain_words",
)


def statistics_of(raw: bytes) -> np.ndarray:
    """Transformed statistics of a text: logarithms of counts and lengths, log odds of shares."""
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size, words = len(raw), raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [line for line in raw.split(b"\n") if line]
    plain = sum(w.isalpha() for w in words)
    shares = np.append(
        counts @ _TABLE / max(size, 1),
        [
            (lengths > 12).mean() if n else 0.0,
            len(set(words)) / n if n else 0.0,
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            plain / n if n else 0.0,
        ],
    )
    odds = np.log((shares + 0.002) / (1.002 - shares))
    groups = len(_GROUPS)
    return np.concatenate(
        (
            np.log1p([size, n]),
            odds[:groups],
            [np.log1p(lengths.mean() if n else 0.0)],
            odds[groups : groups + 3],
            [np.log1p(n / max(len(lines), 1))],
            odds[groups + 3 :],
        )
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text, null as empty."""
    kind = pa.list_(pa.float64())

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics_of((t or "").encode()) for t in texts.to_pylist()], kind)

    return docs.select("doc_id", F.arrow_udf(of, "array<double>")("text").alias("x"))


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per label the sums of (1, x) times its transpose, over (x, label) rows."""
    width = len(STATISTICS) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width))
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                x = np.hstack((np.ones((len(x), 1)), x))
                labels = np.asarray(batch.column(1))
                for label in (0, 1):
                    mine = x[labels == label]
                    sums[label] += mine.T @ mine
        label, place = np.divmod(np.arange(2 * width * width), width * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label), pa.array(place), pa.array(sums.ravel())], ["label", "place", "value"]
        )

    parts = rows.select("x", "label").mapInArrow(partial, "label long, place long, value double")
    total = parts.groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    found = {0: np.zeros((width, width)), 1: np.zeros((width, width))}
    for row in total:
        found[row["label"]].flat[row["place"]] = row["value"]
    return found


@dataclass(frozen=True)
class Quadratic:
    """Two Gaussians over standardised statistics; ``slope`` and ``offset`` are the logistic curve's."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # lower Cholesky factors
    constants: np.ndarray  # log prior less half the log determinant
    slope: float = 1.0
    offset: float = 0.0

    def squeezed(self, x: np.ndarray) -> np.ndarray:
        """The inverse hyperbolic sine of the log-density difference, row by row."""
        z = (x - self.centre) / self.scale
        density = [
            constant - 0.5 * (np.linalg.solve(factor, (z - mean).T) ** 2).sum(axis=0)
            for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return np.arcsinh(density[1] - density[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 + 0.5 * np.tanh(0.5 * (self.slope * self.squeezed(x) + self.offset))


@dataclass(frozen=True)
class Constant:
    """For labelled rows of one class only, or none: the share of label 1, or one half."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def discriminant(sums: dict[int, np.ndarray]) -> Quadratic | Constant:
    """The model of the classes' moments, before its logistic curve is fitted."""
    sizes = np.array([sums[0][0, 0], sums[1][0, 0]])
    if sizes.min() < 2:
        return Constant(float(sizes[1] / sizes.sum()) if sizes.sum() else 0.5)
    both = sums[0] + sums[1]
    centre = both[0, 1:] / sizes.sum()
    spread = np.diag(both)[1:] / sizes.sum() - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-8))
    means, covariances = [], []
    for label in (0, 1):
        mean = sums[label][0, 1:] / sizes[label]
        covariance = sums[label][1:, 1:] / sizes[label] - np.outer(mean, mean)
        means.append((mean - centre) / scale)
        covariances.append(covariance / np.outer(scale, scale))
    pooled = sum(c * n for c, n in zip(covariances, sizes, strict=True)) / sizes.sum()
    factors = []
    for covariance in covariances:
        mixed = (1 - TO_POOLED) * covariance + TO_POOLED * pooled
        sphere = np.eye(len(mixed)) * max(np.trace(mixed) / len(mixed), 1e-3)
        factors.append(np.linalg.cholesky((1 - TO_SPHERE) * mixed + TO_SPHERE * sphere))
    constants = [np.log(n / sizes.sum()) - np.log(np.diag(f)).sum() for f, n in zip(factors, sizes, strict=True)]
    return Quadratic(centre, scale, np.array(means), np.array(factors), np.array(constants))


def logistic_curve(margins: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and offset from counts per margin and label, by Newton steps with a small penalty."""
    total, positive = counts.sum(axis=1), counts[:, 1]
    design = np.column_stack((margins, np.ones(len(margins))))
    found = np.array([1.0, 0.0])
    for _ in range(50):
        p = 0.5 + 0.5 * np.tanh(0.5 * (design @ found))
        gradient = design.T @ (total * p - positive) + 0.1 * (found - [1.0, 0.0])
        weight = np.maximum(total * p * (1 - p), 1e-9 * total)
        step = np.linalg.solve(design.T @ (design * weight[:, None]) + 0.1 * np.eye(2), gradient)
        found = found - np.clip(step, -1, 1)
    return max(float(found[0]), 1e-3), float(found[1])


def trained(rows: DataFrame) -> Quadratic | Constant:
    """The model of (x, label) rows."""
    model = discriminant(moments(rows))
    if isinstance(model, Constant):
        return model
    bins, reach = BINS, SQUEEZED

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * bins, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                place = np.clip(((model.squeezed(x) / reach + 1) / 2 * bins).astype(int), 0, bins - 1)
                counts += np.bincount(2 * place + np.asarray(batch.column(1)), minlength=2 * bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * bins)), pa.array(counts)], ["place", "rows"])

    filled = rows.select("x", "label").mapInArrow(binned, "place long, rows long")
    counts = np.zeros((bins, 2))
    for row in filled.groupBy("place").agg(F.sum("rows").alias("rows")).collect():
        counts.flat[row["place"]] = row["rows"]
    centres = ((np.arange(bins) + 0.5) / bins * 2 - 1) * reach
    slope, offset = logistic_curve(centres, counts)
    return replace(model, slope=slope, offset=offset)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, x), one row per row of ``docs``.

    Learns from rows outside the held-out share that have a label; of several labels of one id the
    highest counts, null ids and labels are left out. Null and empty texts are scored as the empty
    text. Other columns are not read; repeated rows count and score alike; an empty table gives no
    rows.
    """
    rows = written(statistics(docs), "statistics")
    named = (
        labels.where(F.col("quality").isNotNull() & (share_of(F.col("doc_id"), PARTS) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1))
    )
    model = trained(rows.join(named, "doc_id"))

    def of(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        return pa.array(model.score(np.asarray(x.flatten()).reshape(len(x), -1)))

    return rows.select("doc_id", F.arrow_udf(of, "double")("x").alias("score"), "x")
