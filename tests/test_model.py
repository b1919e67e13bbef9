"""Baseline model, artifacts and window scoring."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import datasets, metrics, model
from tickloom.sources.tables import create_tables, read_metadata, write_keyed


def test_baseline_learns_and_saves(spark, tmp_path):
    rows = [(k % 3, 1.0, [float(k % 3) + float(0.1 * np.sin(k)), 1.0]) for k in range(150)]
    df = spark.createDataFrame(rows, "y int, w double, x array<double>")
    fitted = model.train_baseline(df)
    out = model.predict_baseline(fitted, df)
    assert metrics.scores(out).first().macro_f1 > 0.9 and len(out.first().probs) == 3
    model.save_artifacts(str(tmp_path), fitted, {"a": (0.0, 1.0)}, {"seq_len": 2}, {"macro_f1": 0.9})
    assert read_metadata(spark, f"{tmp_path}/metadata")["features"] == ["a"]


def test_window_scoring(spark, at):
    df = spark.createDataFrame([("BTC", at(), 0.01, [[1.0, 2.0], [3.0, 4.0]])], "symbol string, time timestamp, sigma double, x array<array<float>>")
    row = model.predictions(model.score_windows(df, lambda x: x[:, -1, :1] * np.array([[0.0, 0.0, 1.0]])), "v1").first()
    assert row.signal == 1 and row.prob_up > 0.8 and abs(row.prob_down + row.prob_flat + row.prob_up - 1) < 1e-12
    assert model.score_windows(df.filter(F.lit(False)), lambda x: x).count() == 0


def test_walk_forward_and_refit(spark, at):
    """A sign that the label follows is learnt in every fold, with normalisers of earlier bars only."""
    rng = np.random.default_rng(0)
    rows = [(s, at(k), float(v := rng.normal(5, 2)), 1.0, int(np.sign(v - 5))) for s in ("BTC", "ETH") for k in range(400)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp, a double, b double, label int")
    labels = df.select("symbol", "time", "label", F.col("time").alias("t1"), F.lit(1.0).alias("sample_weight"))
    features = df.select("symbol", "time", "a", "b")
    found = datasets.samples(features, labels, 3, ("a", "b"))
    folds, fitted, stats = model.evaluate_and_refit(features, found, ("a", "b"), 3, 4, 5)
    assert [f["fold"] for f in folds] == [1, 2, 3] and all(f["accuracy"] > 0.9 for f in folds)
    assert stats["b"] == (1.0, 1.0) and abs(stats["a"][0] - 5) < 0.5 and fitted.numClasses == 3


def test_latest_inference(spark, at):
    rows = [(s, at(k), float(k), 0.01) for s, n in (("BTC", 5), ("ETH", 2), ("XRP", 4)) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp, a double, sigma_ewma double").withColumn("a", F.when((F.col("symbol") != "XRP") | (F.col("time") < at(3)), F.col("a")))
    out = model.infer_latest(df, lambda x: np.stack([x[:, 0, 0], x[:, 1, 0], x[:, 2, 0]], 1), "v", 3, ("a",)).collect()
    assert [(r.symbol, r.time, r.signal, r.sigma) for r in out] == [("BTC", at(4), 1, 0.01)]  # ETH is short, XRP has a gap


def test_stored_samples(spark, tmp_path, at):
    root = str(tmp_path)
    create_tables(spark, root)
    write_keyed(spark.createDataFrame([(s, at(k), 0.1 * k, 1.0) for s in ("BTC", "ETH") for k in range(6)], "symbol string, time timestamp, ret_1 double, ret_5 double"), root, "bar_features")
    write_keyed(spark.createDataFrame([("BTC", at(k), 1, at(k + 2), 0.5) for k in (1, 4)], "symbol string, time timestamp, label int, t1 timestamp, sample_weight double"), root, "labels")
    features, found = datasets.stored_samples(spark, root, ("BTC",), 3, ("ret_1", "ret_5"), windows=True)
    row = found.collect()
    assert features.count() == 6 and [(r.e_idx, r.t0, r.t1, r.y, r.w) for r in row] == [(4, at(4), at(6), 2, 0.5)] and np.allclose(row[0].x, [[0.2, 1], [0.3, 1], [0.4, 1]])


def test_onnx_scorer_asks_for_the_model_on_executors(spark, at, monkeypatch):
    """The scorer feeds float windows to the first input of the session and gives its first output."""

    class Session:
        def get_inputs(self):
            return [type("Input", (), {"name": "x"})]

        def run(self, outputs, fed):
            assert outputs is None and fed["x"].dtype == np.float32
            return [fed["x"][:, -1, :]]

    monkeypatch.setattr(model, "onnx_session", lambda path: Session())
    assert model.onnx_logits("m.onnx")(np.ones((2, 3, 3), np.float32)).shape == (2, 3)


def test_human_count(spark):
    from tickloom.functions.exprs import human_count

    df = spark.createDataFrame([(7,), (1500,), (1_234_567,), (3_000_000_000,), (None,)], "n long")
    assert [r[0] for r in df.select(human_count("n")).collect()] == ["7", "1.5k", "1.2M", "3.0G", None]
