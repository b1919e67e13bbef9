"""CUSUM, barriers, uniqueness, datasets and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import datasets as D
from tickloom.operators import labels as L
from tickloom.operators import metrics as M

NAN = float("nan")


@pytest.mark.parametrize(("moves", "bars", "want"), [([0.01] * 9, [0.025] * 9, [2, 5, 8]), ([-0.01] * 9, [0.025] * 9, [2, 5, 8]), ([NAN, 0.03, 0.03], [NAN, 0.02, 0.02], [1, 2]), ([0.03, 0.03], [NAN, 0.05], [1])])
def test_cusum(spark, moves, bars, want):
    df = spark.createDataFrame([("A", i, m, b) for i, (m, b) in enumerate(zip(moves, bars, strict=True))], "symbol string, idx long, ret double, threshold double")
    assert sorted(r.idx for r in L.cusum_events(df).collect()) == want


@pytest.mark.parametrize("rows", [1, 2, 7, 40, 1000])
def test_cusum_by_chunks(spark, rows):
    """Cuts at every place: chunks that are run from guessed states give the events of one run over the series."""
    rng, data, want = np.random.default_rng(4), [], set()
    kinds = {"A": (rng.normal(0, 0.01, 150), np.full(150, 0.03)), "drift": (np.full(40, 0.001), np.full(40, 0.0155)), "gaps": (np.where(rng.random(90) < 0.1, NAN, rng.normal(0, 0.02, 90)), np.where(rng.random(90) < 0.3, NAN, 0.02)), "never": (np.full(30, 0.01), np.zeros(30))}
    for symbol, (moves, bars) in kinds.items():
        state = L.Cusum()
        for i, (m, b) in enumerate(zip(moves, bars, strict=True)):
            data.append((symbol, i, float(m), float(b)))
            if state.step(m, b):
                want.add((symbol, i))
    df = spark.createDataFrame(data, "symbol string, idx long, ret double, threshold double").repartition(3)
    assert {tuple(r) for r in L.cusum_events(df, rows=rows).collect()} == want and len(want) > 20
    assert L.cusum_events(df.limit(0), rows=rows).count() == 0


def path(spark, at, n=6, sigma=0.01, **cells):
    rows = [["A", k, at(k), 100.0, 100.0, 100.0, sigma] for k in range(n)]
    for name, (k, v) in cells.items():
        rows[k][{"high": 3, "low": 4, "close": 5}[name]] = v
    return spark.createDataFrame(rows, "symbol string, idx long, time timestamp, high double, low double, close double, sigma double")


def barrier(spark, df, h=3, pt=1.0, sl=1.0, e=0):
    return L.triple_barrier(df, spark.createDataFrame([("A", e)], "symbol string, idx long"), pt, sl, h).collect()


def test_barriers(spark, at):
    up, down, both = {"high": (2, 110.0)}, {"low": (2, 90.0)}, {"high": (2, 110.0), "low": (2, 90.0)}
    for cells, want in ((up, 1), (down, -1), (both, -1), ({}, 0)):
        (row,) = barrier(spark, path(spark, at, **cells))
        assert row.label == want and row.touch_idx == (2 if cells else 3)
    (row,) = barrier(spark, path(spark, at, close=(3, 101.0)))
    assert math.isclose(row.ret, math.log(1.01)) and row.touch_barrier == "vertical"
    assert not barrier(spark, path(spark, at), h=6) and not barrier(spark, path(spark, at, sigma=NAN)) and not barrier(spark, path(spark, at, sigma=0.0))
    (row,) = barrier(spark, path(spark, at), h=2, pt=1.3, sl=0.7)
    assert math.isclose(row.pt_level, 100 * math.exp(1.3 * 0.01 * math.sqrt(2))) and math.isclose(row.sl_level, 100 * math.exp(-0.7 * 0.01 * math.sqrt(2)))


def test_groups_do_not_matter(spark, at, monkeypatch):
    """Barriers found in short runs of bars are those of a plain loop over the whole series."""
    rng = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 200)))
    high, low = close * (1 + 0.01 * rng.random(200)), close * (1 - 0.01 * rng.random(200))
    df = spark.createDataFrame([("A", k, at(k), float(high[k]), float(low[k]), float(close[k]), 0.01) for k in range(200)], "symbol string, idx long, time timestamp, high double, low double, close double, sigma double")
    want = {}
    for k in range(200 - 7):
        wide = 0.01 * math.sqrt(7)
        up, down = close[k] * math.exp(wide), close[k] * math.exp(-0.5 * wide)
        hit = next(((j, -1 if low[j] <= down else 1) for j in range(k + 1, k + 8) if low[j] <= down or high[j] >= up), (k + 7, 0))
        want[k] = (*hit, wide if hit[1] > 0 else -0.5 * wide if hit[1] < 0 else math.log(close[k + 7] / close[k]))
    for size in (50_000, 10):
        monkeypatch.setattr(L, "ROWS_A_GROUP", size)
        got = {r.idx: (r.touch_idx, r.label, r.ret) for r in L.triple_barrier(df, df.select("symbol", "idx"), 1.0, 0.5, 7).collect()}
        assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2], abs_tol=1e-12) for k in want)
    whole = L.labelled_bars(df).orderBy("time").collect()
    assert [r.idx for r in whole] == list(range(200)) and whole[0].sigma is None and whole[9].sigma > 0


def weights(spark, spans, n):
    bars = spark.createDataFrame([("A", i) for i in range(n)], "symbol string, idx long")
    got = L.average_uniqueness(bars, spark.createDataFrame([("A", a, b) for a, b in spans], "symbol string, idx long, touch_idx long"))
    return [r.sample_weight for r in got.orderBy("idx").collect()]


def test_uniqueness(spark):
    assert all(math.isclose(w, 2 / 3) for w in weights(spark, [(0, 2), (1, 3)], 4))
    got = weights(spark, [(6, 14), (13, 16), (15, 25), (16, 22), (26, 27)], 28)
    assert all(0 < w <= 1 for w in got)
    spans = [(k, k + 1 + k % 5) for k in range(20)]
    open_ = [sum(a <= i <= b for a, b in spans) for i in range(30)]
    assert all(math.isclose(w, sum(1 / open_[i] for i in range(a, b + 1)) / (b - a + 1)) for w, (a, b) in zip(weights(spark, spans, 30), spans, strict=True))


def test_samples_skip_gaps(spark, at):
    rows = [("A", at(k), float(k) if k != 5 else None) for k in range(12)]
    feats = spark.createDataFrame(rows, "symbol string, time timestamp, x double")
    labs = spark.createDataFrame([("A", at(k), None, k % 3 - 1, None) for k in range(12)], "symbol string, time timestamp, t1 timestamp, label int, sample_weight double")
    for rows in (4, 5, 1000):
        cut = D.samples(feats, labs, 4, ["x"], windows=True, rows=rows).orderBy("e_idx").collect()
        assert [(r.e_idx, r.x) for r in cut] == [(k, [[float(k - 3 + j)] for j in range(4)]) for k in (3, 4, 9, 10, 11)]
    got = D.samples(feats, labs, 4, ["x"], windows=True).orderBy("e_idx").collect()
    assert [r.e_idx for r in got] == [3, 4, 9, 10, 11]
    assert [r.y for r in got] == [0, 1, 0, 1, 2] and got[0].w == 1.0 and got[0].t1 == got[0].t0 and got[0].x == [[0.0], [1.0], [2.0], [3.0]]


def test_walk_forward_purges(spark, at):
    rows = [("A", k, at(k), at(k + 3), 0, 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, "symbol string, e_idx int, t0 timestamp, t1 timestamp, y int, w double")
    got = D.walk_forward(df, 4, 5, 5).collect()
    ends = {}
    for fold in {r.fold for r in got}:
        test, train = [r for r in got if r.fold == fold and r.role == "test"], [r for r in got if r.fold == fold and r.role == "train"]
        start = min(r.t0 for r in test)
        assert test and train and max(r.t1 for r in train) < start - (at(5) - at(0))
        ends[fold] = len(train)
    assert ends == dict(sorted(ends.items())) and sorted(ends.values()) == [ends[k] for k in sorted(ends)]
    assert D.walk_forward(df.limit(0), 4).count() == 0


def test_normaliser(spark, at):
    df = spark.createDataFrame([("A", at(0), 0.0, 1.0), ("A", at(1), 10.0, 1.0), ("A", at(9), 99.0, 1.0), ("A", at(0), NAN, 1.0)], "symbol string, time timestamp, x double, c double")
    cut = spark.createDataFrame([(1, at(5))], "fold int, cutoff timestamp")
    got = {r.name: (r.mean, r.std) for r in D.normaliser(df, cut, ["x", "c"]).collect()}
    assert got == {"x": (5.0, 5.0), "c": (1.0, 1.0)}
    out = D.normalise(spark.createDataFrame([(15.0, 1.0), (1e9, 2.0), (None, 1.0)], "x double, c double"), got).collect()
    assert [r.x for r in out] == [2.0, 5.0, None]


def test_final_split(spark, at):
    df = spark.createDataFrame([("A", k, at(k), at(k + 1)) for k in range(100)], "symbol string, e_idx int, t0 timestamp, t1 timestamp")
    got = D.final_split(df, 0.15, 4, 5).groupBy("role").agg(F.count("*").alias("n"), F.max("e_idx").alias("m")).collect()
    assert {r.role: (r.n, r.m) for r in got} == {"val": (15, 99), "train": (80, 79)}


def test_metrics(spark):
    y = spark.createDataFrame([(0, 0), (0, 0), (0, 0), (1, 1), (2, 2)], "y int, p int")
    assert [round(r.weight, 9) for r in M.class_weights(y).orderBy("y").collect()] == [round(v, 9) for v in (5 / 9, 5 / 3, 5 / 3)]
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 2)], "y int, p int")
    rows = M.scores(df).orderBy("y").collect()
    assert rows[0].accuracy == 0.75 and math.isclose(rows[0].macro_f1, (2 / 3 + 2 / 3 + 1) / 3)
    assert [tuple(r)[1:] for r in M.confusion(df).orderBy("y").collect()] == [(1, 0, 0), (1, 1, 0), (0, 0, 1)]
    p = spark.createDataFrame([(0, 2.0, [0.5, 0.3, 0.2]), (1, 1.0, [0.2, 0.7, 0.1])], "y int, w double, probs array<double>")
    w = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 1.0)], "y int, weight double")
    assert math.isclose(M.weighted_cross_entropy(p, w).first()[0], (2 * -math.log(0.5) + 3 * -math.log(0.7)) / 3)
