"""Quality by Bradley-Terry pairwise ranking.

Pairs of a good and a bad labelled document are preferences; a linear score is fitted by logistic loss on the
differences of their features.  A score quantile is the threshold, and scores are mapped to 0..1 so that the
threshold falls on 0.3.  Features are shares and lengths taken from the bytes of the whole text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, text_chunks, word_hashes, words_of
from .labelled import labelled_texts, remainder

#: The model is fitted on at most so many labelled documents and so many preference pairs among them.
MOST_LABELLED, PAIRS, BLOCK = 10_000, 20_000, 2_048
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
RIDGE, STEPS, SEED = 1e-3, 12, 7

#: Byte classes: lower, upper, digit, space, line end, other control, non-ASCII, then ASCII punctuation by kind.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[[10, 13]], _CLASS[128:] = 0, 1, 2, 3, 4, 6
for _kind, _chars in enumerate((b".,;:", b"!?", b"%*$#&@^~", b"|", b"<>{}[]()", b"-_/\\+=", b"\"'`"), 7):
    _CLASS[list(_chars)] = _kind
CLASSES = 14
FEATURES = CLASSES + CLASSES * CLASSES + 10


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text; null is empty, whose features are all 0."""
    out = []
    for a, b, data, off in text_chunks(texts):
        raw = _raw(texts, a, b)
        n, rows = np.diff(off), b - a
        row = np.repeat(np.arange(rows), n)
        c = _CLASS[raw].astype(np.int64)
        ones = np.bincount(row * CLASSES + c, minlength=rows * CLASSES).reshape(rows, CLASSES)
        same = row[1:] == row[:-1]
        pairs = np.bincount(((row[:-1] * CLASSES + c[:-1]) * CLASSES + c[1:])[same], minlength=rows * CLASSES * CLASSES).reshape(rows, -1)
        starts, ends, first = words_of(data, off, SPACE_WORDS)
        h, words, size = word_hashes(data, starts, ends), np.diff(first), (ends - starts).astype(float)
        of = np.repeat(np.arange(rows), words)
        mean = lambda x: np.bincount(of, x, rows) / np.maximum(words, 1)
        order = np.lexsort((h, of))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        run = np.diff(np.append(np.flatnonzero(new), len(order)))
        top = np.zeros(rows)
        np.maximum.at(top, of[order][new], run)
        last, lead = (c[ends - 1], c[starts]) if len(starts) else (c[:0], c[:0])
        lines = ones[:, 4] + (n > 0)
        extra = np.stack([
            np.log1p(n), np.log1p(words), mean(size) / 10, np.sqrt(np.maximum(mean(size * size) - mean(size) ** 2, 0)) / 10, np.bincount(of[order][new], minlength=rows) / np.maximum(words, 1),
            top / np.maximum(words, 1), mean((last >= 7).astype(float)), mean((lead == 1).astype(float)), np.log1p(words / np.maximum(lines, 1)), mean((size <= 3).astype(float)),
        ], 1)
        out.append(np.hstack([ones / np.maximum(n, 1)[:, None], pairs / np.maximum(n, 1)[:, None], extra]).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)


def _raw(texts: pa.Array, a: int, b: int) -> np.ndarray:
    """The bytes of rows a..b-1 as they are (capitals count here)."""
    part = texts.slice(a, b - a).cast(pa.large_binary()).fill_null(b"")
    _, off, data = part.buffers()
    off = np.frombuffer(off, np.int64)[part.offset : part.offset + len(part) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)


@dataclass
class QualityModel:
    mean: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, texts: pa.Array) -> np.ndarray:
        x = features(texts).astype(np.float64)
        z = np.clip((x - self.mean) @ self.weights - self.cut + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Newton steps on the ridge-penalised logistic loss of feature differences; a constant score where one class is missing."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(FEATURES), np.zeros(FEATURES), 0.0 if len(good) or not len(bad) else 1.0)
    mean, spread = x.mean(0), x.std(0)
    keep = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
    rng = np.random.default_rng(SEED)
    better, worse = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        grad, curve = -RIDGE * w, RIDGE * np.eye(len(w))
        for k in range(0, PAIRS, BLOCK):
            d = (x[better[k : k + BLOCK]] - x[worse[k : k + BLOCK]]) * keep
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad += d.T @ p / PAIRS
            curve += (d * (p * (1 - p))[:, None]).T @ d / PAIRS
        w += np.linalg.solve(curve, grad)
    s = ((x - mean) * keep) @ w
    cuts = np.quantile(s, np.linspace(0, 1, 401))
    right = [np.mean((s >= t) == (y == 1)) for t in cuts]
    best = int(np.argmax(right))
    above, below = s[s >= cuts[best]], s[s < cuts[best]]
    cut = (above.min() + below.max()) / 2 if len(above) and len(below) else cuts[best]
    return QualityModel(mean, keep * w, float(cut))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most MOST_LABELLED labelled documents outside the held-out fold; only their features leave the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["x", "y"])

    sample = labelled_texts(docs, labels, label, FOLDS, HELD_OUT, id_col, text_col, MOST_LABELLED).mapInArrow(run, "x binary, y int")
    rows = sample.orderBy(F.xxhash64("x"), "x", "y").limit(MOST_LABELLED).toArrow()  # an id may have any number of rows
    both = sorted(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), strict=True))  # the same model in whatever order they come
    x = np.frombuffer(b"".join(v for v, _ in both), np.float32).reshape(-1, FEATURES)
    return fit_pairs(x.astype(np.float64), np.array([v for _, v in both], np.int64))


def score_udf(docs: DataFrame, model):
    """A column function: the model's score of a text column, from a broadcast model of fixed size."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(texts), pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts score alike; equal texts score alike; a null id is held out; an id with several labels has
    the largest, and each row of an id counts; without labels of both classes every score is the same; other columns
    are not read.
    """
    score = score_udf(docs, fit_quality(docs, labels, "quality", id_col, text_col))
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (remainder(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT).alias("held_out"), score(F.col(f"`{text_col}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, whole, that are predicted good; rows of equal text share the decision, null text is empty."""
    score = score_udf(docs, fit_quality(docs, labels, "quality", id_col, text_col))
    return docs.filter(score(F.col(f"`{text_col}`")) >= CUT)
