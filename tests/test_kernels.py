"""Recursions, expressions and windows by hand and against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import carried as C
from tickloom.functions import exprs as X
from tickloom.functions import recursive as R
from tickloom.functions.series import Series, in_chunks, latest, numbered, running_sum
from tickloom.schemas import FEATURE_CATEGORIES, FEATURE_NAMES, TABLES

NAN = float("nan")


def walk(n, seed=0):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))


def test_catalogue():
    assert len(FEATURE_NAMES) == len(set(FEATURE_NAMES)) == 58
    assert [len(v) for v in FEATURE_CATEGORIES.values()] == [11, 6, 4, 10, 3, 8, 5, 3, 4, 4]
    assert TABLES["bar_features"].names == ["symbol", "time", *FEATURE_NAMES]


def test_rma_by_hand():
    assert np.allclose(R.rma([1, 2, 3, 4, 5], 3), [NAN, NAN, 2, 8 / 3, (8 / 3 * 2 + 5) / 3], equal_nan=True)
    assert np.allclose(R.rma([NAN, NAN, 3, 6, 9, 12], 3), [NAN, NAN, NAN, NAN, 6, 8], equal_nan=True)
    assert np.isnan(R.rma([1, 2], 3)).all()


def test_true_range_and_rsi_by_hand():
    assert np.allclose(R.true_range([10, 12, 11], [9, 10, 8], [9.5, 11, 9]), [1, 2.5, 3])
    assert R.rsi(np.arange(1, 40))[-1] == 100 and R.rsi(np.arange(40, 1, -1))[-1] == 0 and R.rsi(np.full(40, 7.0))[-1] == 50
    out = R.rsi(walk(50))
    assert np.isnan(out[:14]).all() and np.isfinite(out[14:]).all()


def test_ewma_std_like_pandas():
    x = np.random.default_rng(1).normal(size=300)
    for bias in (False, True):
        assert np.allclose(R.ewma_std(x, 20, bias=bias), pd.Series(x).ewm(span=20, min_periods=2).std(bias=bias), equal_nan=True)
    with pytest.raises(ValueError):
        R.ewma_std([1, NAN], 5)
    with pytest.raises(ValueError):
        R.sigma([1, 0, 2])
    assert np.isnan(R.sigma(walk(5))[:2]).all()


def step_by_step_adx(high, low, close, p=14):
    """Plain loops."""
    def smooth(x):
        out, first = [NAN] * len(x), next(i for i, v in enumerate(x) if v == v)
        out[first + p - 1] = sum(x[first : first + p]) / p
        for i in range(first + p, len(x)):
            out[i] = (out[i - 1] * (p - 1) + x[i]) / p
        return out
    plus, minus, tr = [], [], []
    for i in range(1, len(close)):
        up, down = high[i] - high[i - 1], low[i - 1] - low[i]
        plus.append(up if up > down and up > 0 else 0.0)
        minus.append(down if down > up and down > 0 else 0.0)
        tr.append(max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])))
    dx = []
    for a, b, t in zip(smooth(plus), smooth(minus), smooth(tr), strict=True):
        a, b = 100 * a / t, 100 * b / t
        dx.append(0.0 if a + b == 0 else 100 * abs(a - b) / (a + b))
    return [NAN, *smooth(dx)]


def test_adx_like_loops():
    c = walk(120)
    h, low = c * 1.004, c * 0.995
    out = R.adx(h, low, c)
    assert np.allclose(out, step_by_step_adx(h, low, c), equal_nan=True) and np.isfinite(out[27:]).all()
    assert np.isnan(R.adx(h[:27], low[:27], c[:27])).all()


def test_ieee_division_and_log(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (6.0, 3.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(X.fdiv("a", "b")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, 2.0, None]
    logs = [r[0] for r in df.select(X.flog("a")).collect()]
    assert logs[0] == 0 and math.isnan(logs[1]) and logs[2] == -math.inf and logs[3] is None


def test_clip_horizon_history(spark):
    row = spark.range(1).select(X.clip(F.lit(None).cast("double"), -5, 5).alias("n"), X.clip(F.lit(NAN), -5, 5).alias("x"), X.clip(F.lit(9.0), -5, 5).alias("c"), X.scale_to_horizon(F.lit(2.0), 4).alias("s")).first()
    assert row.n is None and math.isnan(row.x) and row.c == 5 and row.s == 4
    with pytest.raises(ValueError):
        X.scale_to_horizon("s", 0)
    assert X.minimum_history(100) == math.ceil(math.log(1e-6) / math.log(1 - 2 / 101)) + 1 and X.minimum_history(1) == 3


def test_rolling_is_null_until_full(spark):
    df = spark.createDataFrame([("A", i, float(i) if i != 3 else None) for i in range(7)], "symbol string, time int, x double")
    got = [r[0] for r in df.orderBy("time").select(Series().mean("x", 3)).collect()]
    assert got == [None, None, 1.0, None, None, None, 5.0]


def test_latest(spark):
    df = spark.createDataFrame([("A", 1), ("A", 3), ("B", 2)], "symbol string, time int")
    assert sorted(map(tuple, latest(df).collect())) == [("A", 3), ("B", 2)]


@pytest.mark.parametrize("rows", [20, 33, 1000])
def test_halo_covers_look_back(spark, rows):
    data = [("A", i * 60 + (200_000 if i > 40 else 0), i) for i in range(100)] + [("B", i * 9000, i) for i in range(30)]
    df = spark.createDataFrame(data, "symbol string, s long, i int").withColumn("time", F.timestamp_seconds("s"))
    got = in_chunks(numbered(df), 20, rows)
    own = got.filter("own").select("symbol", "i", "idx", "rows").collect()
    assert sorted((r.symbol, r.i, r.idx, r["rows"]) for r in own) == [*(("A", i, i, 100) for i in range(100)), *(("B", i, i, 30) for i in range(30))]
    assert got.groupBy("symbol", "chunk").count().agg(F.max("count")).first()[0] <= rows + 20
    s = Series(("symbol", "chunk"))
    whole = {(r.symbol, r.i): r.v for r in df.select("symbol", "i", Series().sum("i", 21).alias("v")).collect()}
    cut = {(r.symbol, r.i): r.v for r in got.withColumn("v", s.sum("i", 21)).filter("own").collect()}
    assert cut == whole


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_running_sum(spark, rows):
    df = spark.createDataFrame([(s, i, None if i % 5 == 3 else i) for s in "AB" for i in range(40)], "symbol string, idx long, x int")
    got = {(r.symbol, r.idx): r.upto for r in running_sum(df, "x", "upto", rows=rows).collect()}
    assert got == {(s, i): sum(k for k in range(i + 1) if k % 5 != 3) for s in "AB" for i in range(40)}


def bars_of(n, flat=0, seed=0):
    rng = np.random.default_rng(seed)
    close = walk(n, seed)
    close[:flat] = 100
    before = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(close, before) * (1 + abs(rng.normal(0, 0.002, n))), np.minimum(close, before) * (1 - abs(rng.normal(0, 0.002, n)))
    high[:flat] = low[:flat] = 100
    return high, low, close


@pytest.mark.parametrize("flat", [0, 5, 20, 40])
def test_carried_state_equals_one_pass(flat):
    """Chunks of any size, run from the state of the chunk before, give the features of the whole series."""
    for n in (1, 2, 14, 15, 28, 29, 200):
        high, low, close = bars_of(n, min(flat, n))
        want = R.recursive_arrays(high, low, close)
        for size in (1, 2, 3, 13, 14, 29, 64, 1000):
            state, moments, ranged, index, maps, got = np.zeros(len(C.LINEAR)), C.Moments(), None, 0.0, [], {k: [] for k in C.CARRIED}
            for a in range(0, n, size):
                led = max(a - 1, 0)
                part = C.Chunk(a, high[led : a + size], low[led : a + size], close[led : a + size])
                for k, v in part.features(state, moments, ranged, index).items():
                    got[k].append(v)
                dx, at = part.direction(state, ranged)
                index = C.rma_from(dx, at, index)[-1] if len(dx) else index
                ranged = part.first_range() if ranged is None else ranged
                maps.append(part.map())
                state, moments = maps[-1][0] @ state + maps[-1][1], moments.then(C.Moments.of(part.ret))
            _, states = C.prefix_maps(np.array([m for m, _ in maps]), np.array([b for _, b in maps]))
            assert np.allclose(states[-1], state, rtol=1e-12, atol=1e-12)
            for k in R.RECURSIVE:
                assert np.allclose(np.concatenate(got[k]), want[k], rtol=1e-9, atol=1e-10, equal_nan=True), (n, size, k)


def test_prices_must_be_positive():
    with pytest.raises(ValueError, match="positive"):
        C.Chunk(0, np.ones(2), np.ones(2), np.array([1.0, 0.0]))


def test_maps_compose_in_any_grouping():
    rng = np.random.default_rng(1)
    a, b, c = ((rng.normal(size=(3, 3)), rng.normal(size=3)) for _ in range(3))
    left, right = C.compose(C.compose(a, b), c), C.compose(a, C.compose(b, c))
    assert np.allclose(left[0], right[0]) and np.allclose(left[1], right[1])
    m, v = C.prefix_maps(*(np.array(x) for x in zip(a, b, c, strict=True)))
    assert np.allclose(m[-1], left[0]) and np.allclose(v[-1], left[1])
