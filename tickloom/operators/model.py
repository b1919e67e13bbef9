"""A baseline classifier, artifacts, and scoring of feature windows by any model that maps batches to logits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import argmax, softmax
from ..schemas import BAR_MINUTES, EMBARGO_BARS, FEATURE_NAMES, N_SPLITS, SEQ_LEN, VAL_FRACTION
from ..sources.tables import write_metadata
from .datasets import final_split, fold_cutoffs, latest_windows, normalise, normaliser, walk_forward
from .metrics import class_weights, scores


def train_baseline(train: DataFrame, n_classes: int = 3, max_iter: int = 50):
    """Multinomial logistic regression on (x array, y, w); each row weighs w times its class weight."""
    df = train.join(F.broadcast(class_weights(train, n_classes)), "y").select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"), (F.col("w") * F.col("weight")).alias("weight"))
    return LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter).fit(df)


def predict_baseline(model, df: DataFrame) -> DataFrame:
    """`df` (x array) with probs and p."""
    out = model.transform(df.withColumn("features", array_to_vector("x")))
    return out.withColumn("probs", vector_to_array("probability")).withColumn("p", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def save_artifacts(folder: str, model, stats: dict[str, tuple[float, float]], config: dict, metrics: dict, spark: SparkSession | None = None) -> None:
    """Model folder and a metadata document with the normaliser, feature order, configuration and metrics, by Spark's file system."""
    model.write().overwrite().save(f"{folder}/model")
    content = {"features": list(stats), "mean": [m for m, _ in stats.values()], "std": [s for _, s in stats.values()], "config": config, "metrics": metrics}
    write_metadata(spark or SparkSession.active(), f"{folder}/metadata", content)


def _fitted(features: DataFrame, part: DataFrame, names: Sequence[str], cutoff, train_role: str) -> tuple:
    """(model, normaliser, scored other rows) of one split (symbol, t0, y, w, role); features of a sample are those of its bar."""
    stats = {r["name"]: (r["mean"], r["std"]) for r in normaliser(features, cutoff, names).collect()}  # a row a feature
    x = normalise(features.select("symbol", F.col("time").alias("t0"), *names), stats).select("symbol", "t0", F.array(*names).alias("x"))
    rows = part.join(x, ["symbol", "t0"])
    model = train_baseline(rows.filter(F.col("role") == train_role))
    return model, stats, predict_baseline(model, rows.filter(F.col("role") != train_role))


def evaluate_and_refit(features: DataFrame, found: DataFrame, names: Sequence[str], n_splits: int = N_SPLITS, embargo_bars: int = EMBARGO_BARS, bar_minutes: int = BAR_MINUTES, val_frac: float = VAL_FRACTION) -> tuple[list[dict], object, dict]:
    """(metrics of each fold, final model, its normaliser): a purged walk-forward evaluation, then a fit on all but the last share.

    `found` are samples of `features`.  Each fold has its own normaliser, fitted on the bars before its cut-off.
    """
    split, out = walk_forward(found, n_splits, embargo_bars, bar_minutes), []
    for c in fold_cutoffs(split, embargo_bars, bar_minutes).orderBy("fold").collect():  # a row a fold
        cutoff = features.sparkSession.createDataFrame([c], "fold int, cutoff timestamp")
        _, _, scored = _fitted(features, split.filter(F.col("fold") == c["fold"]), names, cutoff, "train")
        out.append({"fold": c["fold"]} | scores(scored).select("accuracy", "macro_f1").first().asDict())
    last = final_split(found, val_frac, embargo_bars, bar_minutes)
    gap = F.expr(f"make_dt_interval(0, 0, {int(embargo_bars * bar_minutes)}, 0)")
    cutoff = last.filter("role = 'val'").agg((F.min("t0") - gap).alias("cutoff")).select(F.lit(0).alias("fold"), "cutoff")
    model, stats, _ = _fitted(features, last, names, cutoff, "train")
    return out, model, stats


@cache
def onnx_session(path: str):
    """An ONNX Runtime session, once per Python worker."""
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


def onnx_logits(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer of float32 windows (batch, steps, features) from a model file that executors can read."""

    def run(x: np.ndarray) -> np.ndarray:
        session = onnx_session(path)
        return session.run(None, {session.get_inputs()[0].name: x})[0]

    return run


def score_windows(df: DataFrame, logits: Callable[[np.ndarray], np.ndarray], x: str = "x", keep: Sequence[str] = ("symbol", "time", "sigma")) -> DataFrame:
    """`keep` columns and `logits` of each row's window; Arrow batches go to the model as one array."""
    rows = df.select(*keep, x)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.asarray(logits(np.array(batch.column(len(keep)).to_pylist(), np.float32)), np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(list(z), pa.list_(pa.float64()))], [*keep, "logits"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keep), "logits array<double>"]))


def infer_latest(features: DataFrame, logits: Callable[[np.ndarray], np.ndarray], version: str, seq_len: int = SEQ_LEN, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """model_predictions rows of the latest bar of each symbol; none for a symbol whose last window is short or not finite."""
    return predictions(score_windows(latest_windows(features, seq_len, names).filter("x is not null"), logits), version)


def predictions(scored: DataFrame, version: str) -> DataFrame:
    """model_predictions rows: softmax of the logits; the stored signal is the likeliest class."""
    df = softmax(scored, "logits", "p")
    return df.select("symbol", "time", F.lit(version).alias("model_version"), F.col("p")[0].alias("prob_down"), F.col("p")[1].alias("prob_flat"), F.col("p")[2].alias("prob_up"), (argmax(F.col("p")) - 1).cast("short").alias("signal"), "sigma")
