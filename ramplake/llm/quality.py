"""A quality classifier from trusted positives and unlabelled web text (positive-unlabelled learning).

The model is linear in features of the whole text and is fitted by minimising the non-negative unbiased risk
prior * R(positive as good) + max(0, R(unlabelled as bad) - prior * R(positive as bad)) with the logistic loss, so a
score estimates the probability of label 1. The class prior is estimated from the data: a first model is fitted on
half of the positives, and the prior is the smallest ratio, over its score thresholds, of the unlabelled share above to
the share of the other positives above. Rows labelled bad are never used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ramplake.llm.common import slices
from ramplake.llm.rules import repeated_words

#: Bounds of the sample that the model is fitted on; each is met in expectation by a threshold on a hash.
POSITIVES, UNLABELLED = 12_000, 24_000
THRESHOLD = 0.3
FOLDS = 5
STEPS, RATE, DECAY = 600, 0.05, 1e-3

CLASSES = np.full(256, 6, np.uint8)  # bytes beyond ASCII
CLASSES[:128] = 5  # punctuation and controls
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[32], CLASSES[10] = 0, 1, 2, 3, 4
N_CLASSES = 7
PUNCTUATION = [b for b in range(33, 127) if CLASSES[b] == 5]
N_FEATURES = len(PUNCTUATION) + N_CLASSES + N_CLASSES**2 + 8


def features(text: str) -> np.ndarray:
    """Rates of punctuation marks, byte classes and pairs of them, and measures of words, lines and repetition."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    n = max(1, len(data))
    bytes_seen = np.bincount(data, minlength=256)
    kinds = CLASSES[data]
    pairs = np.bincount(kinds[:-1] * np.uint8(N_CLASSES) + kinds[1:], minlength=N_CLASSES**2)
    classes = np.bincount(CLASSES, weights=bytes_seen, minlength=N_CLASSES)
    words = raw.split()
    w = max(1, len(words))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    again = sum(map(bytes.__eq__, words, words[1:]))
    rates = np.concatenate([bytes_seen[PUNCTUATION] / n, classes / n, pairs / n])
    rest = [
        np.log1p(len(words)), np.log1p(n / w), len(set(words)) / w, repeated_words(words) / w, again / w,
        (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(w / max(1, len(lines))), float(not words)]
    return np.concatenate([np.sqrt(rates), rest]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = standard(x, self.mean, self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Without positives or without unlabelled texts nothing can be learnt: every score is one half.
BLANK = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.subtract(x, mean, out=out)
    out /= scale
    return np.clip(out, -6, 6, out=out)


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; where the bad part falls below zero, its gradient is reversed. The rows are read as
    they are, without copies; the parameters, bias last, are of double precision."""
    d = positive.shape[1]
    theta, first, second = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    decay = np.append(np.full(d, DECAY), 0.0)

    def outputs(x: np.ndarray) -> np.ndarray:
        return x @ theta[:-1].astype(x.dtype) + theta[-1]

    def mean_of(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
        return np.append(x.T @ factors.astype(x.dtype), factors.sum()) / len(x)

    for step in range(1, steps + 1):
        zp, zu = outputs(positive), outputs(unlabelled)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_bad = mean_of(unlabelled, su) - prior * mean_of(positive, sp)
        gradient = -prior * mean_of(positive, 1 - sp) + g_bad if bad >= 0 else -g_bad
        gradient = gradient + decay * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def class_prior(held: np.ndarray, unlabelled: np.ndarray, slack: float = 0.05) -> float:
    """The share of positives in the unlabelled scores: min over thresholds of the shares above, with a margin of chance."""
    cuts = np.unique(np.quantile(held, np.linspace(0, 0.9, 91)))
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    above_p = 1 - np.searchsorted(np.sort(held), cuts) / len(held)
    margin = np.sqrt(np.log(2 / slack) / 2) * (len(held) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The arrays are overwritten with their standardised values: the sample is held once."""
    if not len(positive) or not len(unlabelled):
        return BLANK
    mean = unlabelled.mean(0, dtype=float)
    scale = np.sqrt(np.maximum(0, [np.square(unlabelled[:, k] - m).mean(dtype=float) for k, m in enumerate(mean)])) + 1e-3
    p, u = (standard(x, mean.astype(x.dtype), scale.astype(x.dtype), out=x) for x in (positive, unlabelled))
    if prior is None:
        if len(p) < 20:
            prior = 0.5
        else:
            w, b = minimise(p[::2], u, 0.5, STEPS // 3)
            prior = class_prior(p[1::2] @ w + b, u @ w + b)
    return Model(mean, scale, *minimise(p, u, prior), prior)


def held_out(doc: str = "doc_id") -> Column:
    """One fold of five by the id's text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit(""))) % FOLDS == 0


def training_ids(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """A sample of ids outside the held-out fold: columns doc_id and positive. Its size is bounded by the two parameters,
    up to the chance of a hash. Unlabelled are all documents, whatever their labels: the risk is that of all text."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("low"))
    trusted = known.filter(~held_out()).filter("low = 1").select("doc_id", F.lit(True).alias("positive"))
    web = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long")).distinct().select("doc_id", F.lit(False).alias("positive"))

    def thinned(rows: DataFrame, bound: int) -> DataFrame:
        share = bound / max(bound, rows.count())
        return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    return thinned(trusted, positives).union(thinned(web, unlabelled))


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """The model of a bounded sample of `docs`. Null texts are empty ones; rows without id and labels that are null count
    for nothing; without trusted positives or without documents outside the held-out fold, the blank model."""
    ids = F.broadcast(training_ids(docs, labels, positives, unlabelled))  # 36,000 short rows at most, by the bounds
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    rows = rows.select("doc_id", "positive", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.record_batch([*part.columns[:3], pa.array([features(t).tobytes() for t in texts], pa.binary())], ["doc_id", "positive", "h", "x"])

    found = rows.mapInArrow(run, "doc_id long, positive boolean, h long, x binary")
    # one row for each id and text, however often a table repeats it
    sample = found.groupBy("doc_id", "positive", "h").agg(F.first("x").alias("x")).select("positive", "x").toArrow()
    # in one order, whatever the tasks' order was; each part is one array, held once
    parts = []
    for flag in (True, False):
        found = sorted(x for x, positive in zip(sample["x"].to_pylist(), sample["positive"].to_pylist()) if positive == flag)
        parts.append(np.frombuffer(bytearray().join(found), np.float32).reshape(-1, N_FEATURES))
    del sample, found
    return fit(*parts, prior)


def score(docs: DataFrame, model: Model, *, text: str = "text", doc: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Columns doc_id, held_out, score and predicted for every row of `docs`; a null text is scored as an empty one,
    repeated rows get the same score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                scores = model.score(np.stack([features(t) for t in texts]))
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score reaches the threshold."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, batch.schema.names[at]):
                keep = model.score(np.stack([features(t) for t in texts])) >= threshold
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
