"""The live path and the trainer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import live as V
from tickloom.operators import trainer as T
from tickloom.operators.features import compute_features
from tickloom.sources.tables import create_tables, read_metadata, scan, write_keyed, write_metadata

BARS = "symbol string, time timestamp, open double, high double, low double, close double, volume double, trades int"


def stored(spark, root, at, n=900):
    create_tables(spark, root)
    rng, rows = np.random.default_rng(1), []
    for symbol, step in (("BTC", 1), ("ETH", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i in range(0, n, step):
            if symbol == "ETH" and 200 < i < 700:
                continue  # days without bars
            o = close[i - 1] if i else 100.0
            rows.append((symbol, at(i), float(o), float(max(o, close[i]) * 1.001), float(min(o, close[i]) * 0.999), float(close[i]), float(rng.uniform(50, 150)), 5))
    bars = spark.createDataFrame(rows, BARS)
    write_keyed(bars, root, "ohlcv_bars")
    write_keyed(bars.select("symbol", "time", F.lit(1e-4).alias("funding_rate"), (F.col("close") * 10).alias("open_interest")), root, "funding_oi")
    write_keyed(bars.select("symbol", "time", *[F.array(*[F.col("close") + k * s for k in range(1, 6)]).alias(c) for c, s in (("bid_px", -0.1), ("ask_px", 0.1))], *[F.array(*[F.lit(float(k)) for k in range(1, 6)]).alias(c) for c in ("bid_sz", "ask_sz")]), root, "orderbook_snapshots")
    return bars


def test_recent_tables_read_only_the_newest_days(spark, tmp_path, at):
    root = str(tmp_path)
    bars = stored(spark, root, at)
    got = V.recent_tables(spark, root, 300)
    want = {s: [r.time for r in bars.filter(F.col("symbol") == s).orderBy(F.col("time").desc()).limit(300).collect()] for s in ("BTC", "ETH")}
    for s, times in want.items():
        for name in ("ohlcv_bars", "orderbook_snapshots", "funding_oi"):
            rows = sorted((r.time for r in got[name].filter(F.col("symbol") == s).collect()), reverse=True)
            assert rows == times, (s, name)
    for name, df in got.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "symbol" in plan.split("PartitionFilters: [")[1].split("]")[0] and "date" in plan.split("PartitionFilters: [")[1].split("]")[0], name
        assert len(df._jdf.queryExecution().executedPlan().toString()) > 0 and df.count() == 600
    now = F.lit(at(899)).cast("timestamp") + F.expr("interval 10 seconds")
    assert V.recent_tables(spark, root, 5, ("BTC",), now)["ohlcv_bars"].agg(F.max("time")).first()[0] == at(898)
    assert V.recent_tables(spark, str(tmp_path), 10**6)["ohlcv_bars"].count() == bars.count()


def test_live_step_from_tables_to_orders(spark, tmp_path, at):
    root = str(tmp_path)
    bars = stored(spark, root, at)
    names = ("ret_1", "rsi_14", "obi_l1", "funding_rate")
    accounts = spark.createDataFrame([(10_000.0, 0.0, 0, False)], "equity double, daily_pnl double, open_orders int, kill_switch boolean")
    logits = lambda x: np.stack([x[:, -1, 1] * 0 - 5, x[:, -1, 1] * 0, 5 + x[:, -1, 0] * 0], axis=1)
    now = F.lit(at(900)).cast("timestamp")
    scored, orders = V.live_step(spark, root, now, logits, "v1", accounts, 16, 400, names)
    assert sorted((r.symbol, r.time, r.signal) for r in scan(spark, root, "model_predictions").collect()) == [("BTC", at(899), 1), ("ETH", at(899), 1)]
    sigma = {r.symbol: r.sigma_ewma for r in compute_features(bars).filter(F.col("time") == at(899)).collect()}
    assert all(math.isclose(r.sigma, sigma[r.symbol], rel_tol=2e-2) for r in scored.collect())
    rows = scan(spark, root, "orders").orderBy("order_id").collect()
    assert [r.order_id for r in rows] == list(range(1, 7)) and {(r.symbol, r.intent) for r in rows} == {(s, i) for s in ("BTC", "ETH") for i in ("entry", "take_profit", "stop_loss")}
    assert {r.status for r in rows} <= {"pending", "rejected"} and {r.side for r in rows if r.intent == "entry"} == {"buy"}
    V.live_step(spark, root, now, logits, "v2", accounts.withColumn("kill_switch", F.lit(True)), 16, 400, names)
    rows = scan(spark, root, "orders").filter("order_id > 6").collect()
    assert len(rows) == 6 and {(r.status, r.reason) for r in rows if r.intent == "entry"} == {("rejected", "kill switch active")}


def windows(spark, n, seed=0, noise=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6, 2)) * [1, 10] + [0, 100]
    y = np.digitize(x[:, -1, 0] + noise * rng.normal(size=n), [-0.5, 0.5])
    rows = [([[float(v) for v in step] for step in a], int(b), 1.0, "val" if k % 4 == 0 else "train") for k, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "x array<array<double>>, y int, w double, role string"), x, y


STATS = {"a": (0.0, 1.0), "b": (100.0, 10.0)}


def test_trainer_learns_stops_early_and_reloads(spark, tmp_path):
    df, x, y = windows(spark, 1200)
    scorer, log = T.train_scorer(df, STATS, tasks=2, hidden=8, batch=32, epochs=60, rate=0.03, patience=5)
    best = max(r["macro_f1"] for r in log)
    assert best > 0.85 and len(log) < 60 and [r["epoch"] for r in log] == list(range(len(log)))
    assert all(r["macro_f1"] <= best for r in log[-5:]) and log[-6]["macro_f1"] == best  # five epochs without a better one
    one, again = (T.train_scorer(df, STATS, tasks=2, hidden=8, batch=32, epochs=3, rate=0.03) for _ in range(2))
    assert one[1] == again[1] == log[:3] and all((a == b).all() for a, b in zip(one[0].weights, again[0].weights, strict=True))
    scorer.save(spark, str(tmp_path / "scorer"), {"macro_f1": best})
    loaded = T.Scorer.load(spark, str(tmp_path / "scorer"))
    assert np.array_equal(loaded(x), scorer(x)) and read_metadata(spark, str(tmp_path / "scorer"))["metrics"] == {"macro_f1": best}
    flat = df.select(F.flatten("x").alias("x"))
    got = flat.select("x", T.scoring_udf(loaded, 6)("x").alias("z")).collect()
    assert all(np.allclose(r.z, scorer(np.array(r.x).reshape(1, 6, 2))[0]) for r in got)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    weights, s, y, w = T.initial_weights(5, 4, 1), rng.normal(size=(9, 5)), rng.integers(0, 3, 9), rng.uniform(0.5, 2, 9)

    def loss(weights):
        z = T.forward(weights, s)[1]
        return float((w * (np.log(np.exp(z).sum(1)) - z[np.arange(9), y])).sum())

    for k, g in enumerate(T.gradients(weights, s, y, w)[0]):
        for at in np.ndindex(g.shape):
            moved = [a.copy() for a in weights]
            moved[k][at] += 1e-6
            assert abs((loss(moved) - loss(weights)) / 1e-6 - g[at]) < 1e-3


def test_macro_f1():
    assert T.macro_f1(np.array([[1, 0, 0], [1, 1, 0], [0, 0, 1]])) == pytest.approx((2 / 3 + 2 / 3 + 1) / 3) and T.macro_f1(np.zeros((3, 3))) == 0


def test_metadata_by_the_file_system(spark, tmp_path):
    for content in ({"a": [1, 2]}, {"b": "é\n"}):
        write_metadata(spark, str(tmp_path / "m"), content)
        assert read_metadata(spark, str(tmp_path / "m")) == content
