"""A trained scorer of feature windows: mini-batch AdamW in barrier tasks, early stop on validation macro-F1, normaliser inside.

Every task keeps its own rows (a few hundred numbers each) and takes AdamW steps on mini-batches of them; after each epoch the
tasks' weights are averaged by their rows, so all begin the next one from the same.  (A barrier takes up to a second, too long
to average after every step.)  When a task or executor is lost, Spark runs the barrier stage again from the start, and the
seeds make it the same run.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CLIP_SIGMA, FEATURE_NAMES
from ..sources.tables import read_metadata, write_metadata

CLASSES = 3


def summary(x: np.ndarray) -> np.ndarray:
    """(rows, numbers) of normalised windows (rows, steps, features): the last step, the mean, and the change over the window."""
    return np.concatenate([x[:, -1], x.mean(1), x[:, -1] - x[:, 0]], axis=1)


@dataclass
class Scorer:
    """Logits of raw windows: z-scores, clipped, their summary, and a layer of tanh units."""

    mean: np.ndarray
    std: np.ndarray
    weights: list[np.ndarray]
    names: list[str] = field(default_factory=lambda: list(FEATURE_NAMES))

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return summary(np.clip((np.asarray(x, np.float64) - self.mean) / self.std, -CLIP_SIGMA, CLIP_SIGMA))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return forward(self.weights, self.prepare(x))[1]

    def save(self, spark: SparkSession, path: str, metrics: dict | None = None) -> None:
        lists = {"mean": self.mean.tolist(), "std": self.std.tolist(), "weights": [w.tolist() for w in self.weights], "names": self.names}
        write_metadata(spark, path, lists | {"metrics": metrics or {}})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        d = read_metadata(spark, path)
        return cls(np.array(d["mean"]), np.array(d["std"]), [np.array(w) for w in d["weights"]], d["names"])


def initial_weights(inputs: int, hidden: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, CLASSES)), np.zeros(CLASSES)]


def forward(weights: list[np.ndarray], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(s @ weights[0] + weights[1])
    return h, h @ weights[2] + weights[3]


def gradients(weights: list[np.ndarray], s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Sums (not means) over the rows of the weighted cross-entropy's gradients, and of the row weights."""
    h, z = forward(weights, s)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    e = p * w[:, None]
    back = (e @ weights[2].T) * (1 - h * h)
    return [s.T @ back, back.sum(0), h.T @ e, e.sum(0)], float(w.sum())


class AdamW:
    def __init__(self, weights: list[np.ndarray], rate: float, decay: float) -> None:
        self.rate, self.decay, self.t = rate, decay, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        self.t, out = self.t + 1, []
        for k, (w, g) in enumerate(zip(weights, grads, strict=True)):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            move = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            out.append(w - self.rate * (move + self.decay * w * (w.ndim > 1)))
        return out


def macro_f1(confusion: np.ndarray) -> float:
    """Mean of the classes' F1 from counts (true, predicted); a class without any row or prediction counts 0."""
    both = confusion.sum(0) + confusion.sum(1)
    return float(np.mean(np.divide(2 * np.diag(confusion), both, out=np.zeros(len(confusion)), where=both > 0)))


def _shared(context: BarrierTaskContext, arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of the arrays over all tasks, added in the order of the tasks."""
    flat = np.concatenate([a.ravel() for a in arrays])
    total = np.zeros_like(flat)
    for text in context.allGather(base64.b64encode(flat.tobytes()).decode()):
        total += np.frombuffer(base64.b64decode(text))
    cuts = np.cumsum([a.size for a in arrays])[:-1]
    return [part.reshape(a.shape) for part, a in zip(np.split(total, cuts), arrays, strict=True)]


def train_scorer(samples: DataFrame, stats: dict[str, tuple[float, float]], tasks: int = 2, hidden: int = 32, batch: int = 256, epochs: int = 60, patience: int = 5, rate: float = 1e-3, decay: float = 1e-2, seed: int = 0, class_weight: Sequence[float] = (1.0, 1.0, 1.0)) -> tuple[Scorer, list[dict]]:
    """(scorer, metrics by epoch) from `samples` (x: raw windows, y, w, role: train or val).

    After each epoch macro-F1 of the validation rows decides: the best weights are kept, and `patience` epochs without a
    better one end the training.  `tasks` must not exceed the slots of the cluster; a task holds its share of the samples as
    summaries.  Rows of classes weigh `w` times `class_weight`.
    """
    mean, std = (np.array([v[k] for v in stats.values()]) for k in (0, 1))
    scorer = Scorer(mean, std, [], list(stats))
    inputs = 3 * len(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        me, parts = context.partitionId(), []
        for b in batches:
            if b.num_rows:
                parts.append((scorer.prepare(np.array(b.column(0).to_pylist(), np.float64)), b.column(1).to_numpy().astype(int), b.column(2).to_numpy(zero_copy_only=False).astype(float), np.array([r == "train" for r in b.column(3).to_pylist()])))
        s, y, w, train = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, inputs)), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
        val_s, val_y = s[~train], y[~train]
        s, y, w = s[train], y[train], (w * np.array(class_weight)[y])[train]
        weights, best, best_f1, worse, log = initial_weights(inputs, hidden, seed), None, -1.0, 0, []
        adam = AdamW(weights, rate, decay)
        for epoch in range(epochs + 1):
            # The weights at the start of an epoch are judged in the same exchange that ends it.
            confusion = np.zeros((CLASSES, CLASSES))
            np.add.at(confusion, (val_y, forward(weights, val_s)[1].argmax(1)), 1)
            mine = weights
            order = np.random.default_rng([seed, epoch, me]).permutation(len(s)) if epoch < epochs else np.zeros(0, int)
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                grads, n = gradients(mine, s[pick], y[pick], w[pick])
                mine = adam.step(mine, [g / max(n, 1e-12) for g in grads])
            confusion, n, *total = _shared(context, [confusion, np.array([len(s)]), *[len(s) * a for a in mine]])
            if epoch:
                f1 = macro_f1(confusion)
                log.append((epoch - 1, f1, float(np.trace(confusion) / max(confusion.sum(), 1))))
                best, best_f1, worse = (weights, f1, 0) if f1 > best_f1 else (best, best_f1, worse + 1)
                if worse >= patience:
                    break
            weights = [a / n[0] for a in total] if n[0] else weights
        if me == 0:
            rows = {"epoch": [x[0] for x in log], "macro_f1": [x[1] for x in log], "accuracy": [x[2] for x in log], "weights": [None] * (len(log) - 1) + [[a.ravel().tolist() for a in best]]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(rows.items(), (pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.list_(pa.float64()))), strict=True)})

    # Rows are dealt by their content, so that a run that is repeated deals them alike.
    rows = samples.select("x", F.col("y").cast("int"), F.col("w").cast("double"), "role").repartition(tasks, F.xxhash64(F.to_json(F.struct("x", "y", "role"))))
    found = rows.mapInArrow(run, "epoch int, macro_f1 double, accuracy double, weights array<array<double>>", barrier=True).collect()  # a row an epoch
    shapes = [a.shape for a in initial_weights(inputs, hidden, seed)]
    last = next(r["weights"] for r in found if r["weights"] is not None)
    scorer.weights = [np.array(a).reshape(shape) for a, shape in zip(last, shapes, strict=True)]
    return scorer, [{"epoch": r["epoch"], "macro_f1": r["macro_f1"], "accuracy": r["accuracy"]} for r in sorted(found, key=lambda r: r["epoch"])]


def scoring_udf(scorer: Scorer, steps: int) -> Callable[[Column], Column]:
    """A function from a column of flattened windows (steps * features numbers) to logits, by Spark's batch inference."""
    width = len(scorer.names)
    return predict_batch_udf(lambda: lambda x: scorer(x).astype(np.float64), return_type=T.ArrayType(T.DoubleType()), batch_size=1024, input_tensor_shapes=[[steps, width]])
