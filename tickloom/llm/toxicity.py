"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Document frequencies of hashed n-grams are counted by class over all labelled training rows, in a table of fixed
size.  N-grams whose frequencies tell the classes apart, whichever they speak for, are the features: those that pass a
significance level, so there are as many as the labels support (the size of the table bounds them).  Each is
scaled by its log-count ratio, and a logistic regression on their presence is fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_counts
from .common import discard, materialise, text_chunks
from .labelled import labelled_texts, remainder
from .quality import score_udf

SIZES = (3, 4, 5, 6)
LOG2 = 21
#: Log-likelihood ratio from which a bucket is a feature (some hundred of 2**21 reach 8 by chance), and rows of the bounded
#: sample on which the weights are fitted, which bounds what the driver gets.
EVIDENCE, MOST_LABELLED = 8.0, 10_000
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
RIDGE, STEPS, RATE, SMOOTH = 1e-3, 400, 0.5, 0.5
#: Steps over which the loss must fall by the share SMALL of what it began with, and entries of a block.
PATIENCE, SMALL, BLOCK = 20, 1e-3, 1 << 20


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every character n-gram, one size after the other; A-Z come in lower case."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(begins[off]))
    points = points[: len(row)]
    h = np.zeros(len(points), np.uint32)
    for k in range(1, max(SIZES) + 1):
        n = len(points) - k + 1
        if n <= 0:
            return
        h = h[:n] * np.uint32(0x01000193) + points[k - 1 : k - 1 + n]
        if k in SIZES:
            one = row[:n] == row[k - 1 : k - 1 + n]
            mixed = (h ^ np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            yield row[:n][one], (mixed >> np.uint32(32 - LOG2))[one]


def present(texts: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket): each n-gram of a text once, by rows; with `keep`, only buckets flagged there.

    Of the places of a bucket in a text the one that is written last into a table by bucket is kept, which needs no sort.
    """
    place = np.empty(1 << LOG2, np.int32)
    for a, b, data, off in text_chunks(texts):
        got, rows = [], b - a
        for row, at in grams(data, off):
            if keep is not None:
                on = keep[at]
                row, at = row[on], at[on]
            got.append((at, np.searchsorted(row, np.arange(rows + 1)).tolist()))
        found = []
        for r in range(rows):
            every = np.concatenate([at[cuts[r] : cuts[r + 1]] for at, cuts in got]) if got else np.zeros(0, np.uint32)
            order = np.arange(len(every), dtype=np.int32)
            place[every] = order
            found.append(every[place[every] == order])
        size = [len(x) for x in found]
        yield a, rows, np.repeat(np.arange(rows), size), np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


@dataclass
class ToxicityModel:
    keep: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, n, row, at in present(texts, self.keep):
            out[a : a + n] = np.bincount(row, self.weights[at], n)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket, from document frequencies by class."""
    p, q = toxic + SMOOTH, clean + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def evidence(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of each bucket against the same frequency in both classes; `share` of the rows are toxic."""
    both = toxic + clean
    part = lambda k, e: k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9))
    return part(toxic, both * share) + part(clean, both * (1 - share))


def fit_presence(f: np.ndarray, size: np.ndarray, y: np.ndarray, ratios: np.ndarray, keep: np.ndarray) -> ToxicityModel:
    """Logistic regression, by gradient descent with momentum, on ratio-scaled presence of the kept buckets.

    `f` holds the features of the rows one after the other (numbers among the kept buckets), `size` their numbers.  A feature's value is its ratio wherever it
    is present, so the ratios are applied to weights and gradients, and a step goes over the buckets in blocks: beside them
    only arrays of a block's size are made.  Steps end when the loss has stopped falling.
    """
    rows, ratio = len(size), ratios[keep]
    cuts, n = np.concatenate([[0], np.cumsum(size)]), max(len(size), 1)
    edges = [0]
    while edges[-1] < rows:
        edges.append(max(edges[-1] + 1, int(np.searchsorted(cuts, cuts[edges[-1]] + BLOCK, "right")) - 1))
    blocks = list(zip(edges[:-1], edges[1:], strict=True))
    w, b, v, vb = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(len(ratio)), 0.0
    spread = np.sqrt(ratio * ratio * np.bincount(f, minlength=len(ratio)) / n) + 1e-6  # steps by the scale of each feature
    losses: list[float] = []
    for _ in range(STEPS):
        scaled, grad, bias, loss = w * ratio, np.zeros(len(ratio)), 0.0, 0.0
        for i, j in blocks:
            some = f[cuts[i] : cuts[j]]
            upto = np.concatenate([[0.0], np.cumsum(scaled[some])])
            z = np.clip(upto[cuts[i + 1 : j + 1] - cuts[i]] - upto[cuts[i:j] - cuts[i]] + b, -30, 30)
            e = 1 / (1 + np.exp(-z)) - y[i:j]
            loss += float((np.logaddexp(0, z) - y[i:j] * z).sum())
            bias += float(e.sum())
            grad += np.bincount(some, np.repeat(e, size[i:j]), len(ratio))
        losses.append(loss / n + RIDGE / 2 * float((w * w * spread).sum()))
        if len(losses) > PATIENCE and losses[-1 - PATIENCE] - losses[-1] < SMALL * losses[0]:
            break
        v = 0.9 * v - RATE * 0.1 * (grad * ratio / n / spread + RIDGE * w)
        vb = 0.9 * vb - RATE * 0.1 * bias / n
        w, b = w + v, b + vb
    full = np.zeros(len(keep), np.float32)
    full[keep] = w * ratio
    return ToxicityModel(keep, full, float(b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Ratios from every labelled row outside the held-out fold; weights from at most MOST_LABELLED of them."""

    def positions(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        return (y[a + row] << LOG2 | at for a, _, row, at in present(batch.column(0)))

    rows = labelled_texts(docs, labels, label, FOLDS, HELD_OUT, id_col, text_col)
    n, toxic_rows = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if toxic_rows in (0, n):
        return ToxicityModel(np.zeros(1 << LOG2, bool), np.zeros(1 << LOG2), 0.0 if not n else 30.0 if toxic_rows else -30.0)
    counts = bucket_counts(rows, positions, LOG2 + 1, top=1 << 31)
    clean, toxic = counts[: 1 << LOG2].astype(float), counts[1 << LOG2 :].astype(float)
    ratios, found = log_count_ratios(toxic, clean), evidence(toxic, clean, toxic_rows / n)
    keep = found >= EVIDENCE
    del counts, clean, toxic, found
    rank = np.full(len(keep), -1, np.int32)
    rank[keep] = np.arange(keep.sum())
    held = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, row, at in present(batch.column(0), held.value >= 0):
                cuts, at = np.searchsorted(row, np.arange(n + 1)), held.value[at]
                yield pa.RecordBatch.from_arrays([pa.array([at[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), batch.column(1).slice(a, n)], ["x", "y"])

    # The rows of the least hashes, so that the bounded sample is the same each time (an id may have any number of rows; those
    # of one hash are equal).  They come to the driver one partition after the other, and stay there as numbers only.
    sample = labelled_texts(docs, labels, label, FOLDS, HELD_OUT, id_col, text_col, MOST_LABELLED).mapInArrow(run, "x binary, y int")
    sample = materialise(sample.withColumn("h", F.xxhash64("x", "y")), "toxic-sample")
    held.unpersist()
    least = sample.select("h").orderBy("h").limit(MOST_LABELLED).agg(F.max("h")).first()[0]
    chosen = sample.filter(F.col("h") <= least)
    f, y, size, done = np.empty(chosen.agg(F.coalesce(F.sum(F.length("x")), F.lit(0))).first()[0] // 4, np.int32), [], [], 0
    for row in chosen.select("x", "y").toLocalIterator():
        if len(y) < MOST_LABELLED:
            part = np.frombuffer(row["x"], np.int32)
            f[done : done + len(part)] = part
            y.append(row["y"])
            size.append(len(part))
            done += len(part)
    discard(sample)
    return fit_presence(f[:done], np.array(size, np.int64), np.array(y, float), ratios, keep)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts score alike; equal texts score alike; a null id counts as empty text for the folds; an id with
    several labels has the largest, and each row of an id counts; without labels of both classes every score is the
    same; other columns are not read.
    """
    score = score_udf(docs, fit_toxicity(docs, labels, "toxic", id_col, text_col))
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (remainder(F.col(f"`{id_col}`"), FOLDS) == HELD_OUT).alias("held_out"), score(F.col(f"`{text_col}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
