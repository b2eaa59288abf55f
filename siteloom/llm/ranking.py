"""A quality classifier by Bradley-Terry ranking of document pairs.

A document's score is linear in statistics of its text; a preferred document
beats the other with the logistic probability of their score difference.  The
weights are learned from the feature differences of (label 1, label 0) pairs, and
the cut is the quantile of the training scores that matches the share of label 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text

#: Labelled rows that the model is fitted on, at most, and pairs for each label-0 row.
MAX_LABELLED = 20_000
PAIRS_EACH = 40
#: Pairs learned from in all: at most 200 MB of differences on the driver.
MAX_PAIRS = 400_000
CUT_SCORE = 0.3
_SYMBOLS, _CAPS, _DIGITS = b"#*$%&<>{}[]\\^~@_=+/", bytes(range(65, 91)), b"0123456789"
_RATES = ("symbols", "marks", "bars", "caps", "digits", "repeats", "alike", "short")
FEATURES = [f"{k}_{x}" for x in ("most", "mean") for k in _RATES] + ["log_words", "word_length", "same_lines", "stops"]


def _line_rates(words: list[bytes], line: bytes) -> tuple[float, ...]:
    n, size = len(words), len(line)
    return (
        (size - len(line.translate(None, _SYMBOLS))) / n,
        line.count(b"!") / n,
        line.count(b"|") / n,
        (size - len(line.translate(None, _CAPS))) / size,
        (size - len(line.translate(None, _DIGITS))) / size,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        n / size,
    )


def text_features(text: str, least_words: int = 4) -> list[float]:
    """Rates per line (greatest, and mean weighted by words) and of the whole text; zeros without words."""
    lines = [(w, x) for x in text.encode("utf-8", "replace").split(b"\n") if (w := x.split())]
    if not lines:
        return [0.0] * len(FEATURES)
    counts = np.array([len(w) for w, _ in lines], float)
    rates = np.array([_line_rates(w, x) for w, x in lines])
    full = counts >= least_words
    most = rates[full].max(axis=0) if full.any() else rates.max(axis=0)
    words = counts.sum()
    chars = sum(len(x) for _, x in lines)
    same = 1 - len({x for _, x in lines}) / len(lines)
    stops = sum(x.count(b". ") + x.endswith(b".") for _, x in lines) / words
    return [*most, *(counts @ rates / words), math.log(words), chars / words, same, stops]


@dataclass
class Model:
    """Weights over standardised features, and the offset that puts the cut at CUT_SCORE."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        # row by row: a matrix product may differ in its last digit with the number of rows
        return (np.ascontiguousarray(_shaped((x - self.mean) / self.scale)) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.raw(x) - self.cut + math.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def _shaped(z: np.ndarray) -> np.ndarray:
    """Linear, and a hinge on each side, so that both tails of a statistic can count."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-1 - z, 0)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH, most_pairs: int = MAX_PAIRS, ridge: float = 1e-3, rounds: int = 25, seed: int = 5) -> Model | None:
    """Newton steps on the mean logistic loss of pair differences; None without both labels.

    Each row of label 0 takes ``pairs_each`` pairs, or fewer (one at least) where that would be more than ``most_pairs``.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    pairs_each = max(1, min(pairs_each, most_pairs // len(bad)))
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = _shaped((x - mean) / scale)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, len(bad) * pairs_each)] - z[np.repeat(bad, pairs_each)]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        grad = ridge * w - d.T @ p / len(d)
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(bad)
    return Model(mean, scale, w, float((s[k - 1] + s[min(k, len(s) - 1)]) / 2))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model | None:
    """Fit on the labelled documents outside the held-out fold, ``limit`` label rows at most, in hash order.

    Null labels and labels without a document are passed over; of repeated documents of one id and label the
    one with the smallest statistics counts.  Only the texts of these rows are read into features, whole and of any length
    (null or empty: all statistics zero).  Without both labels, as with empty tables, there is no model.
    """
    told = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")).where("_id is not null and _quality in (0, 1)")
    told = told.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id", "_quality").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([text_features(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch([b.column(0), b.column(1), x], names=["id", "y", "x"])

    known = docs.select("doc_id", "text").join(F.broadcast(told), F.col("doc_id") == F.col("_id")).select("_id", "_quality", as_text("text"))
    found = known.mapInArrow(run, "id long, y int, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x"))  # a row per label row at most
    rows = found.toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows]))


def quality_score(model: Model | None) -> Column:
    """Score of the ``text`` column, 0 to 1 (null text: empty); 0.5 for all without a model.

    Equal texts have equal scores; a score of exactly the cut counts as good.
    """

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(text), 0.5))
        x = np.array([text_features(t) for t in text.to_pylist()]).reshape(-1, len(FEATURES))
        return pa.array(model.score(x))

    return score(as_text("text"))
