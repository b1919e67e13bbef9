"""Feature assembly: hand cases, parity of tail and bulk, missing inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import recursive as R
from tickloom.operators import features as O
from tickloom.operators.asof import asof_join
from tickloom.schemas import FEATURE_NAMES

BOOK = "symbol string, time timestamp, bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>"


def make_bars(spark, at, n, symbols=("BTC", "ETH")):
    rows = []
    for k, s in enumerate(symbols):
        rng = np.random.default_rng(k)
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        before = np.concatenate([[100.0], close[:-1]])
        for i in range(n):
            hi, lo = max(close[i], before[i]) * (1 + abs(rng.normal(0, 0.002))), min(close[i], before[i]) * (1 - abs(rng.normal(0, 0.002)))
            rows.append((s, at(i), float(before[i]), float(hi), float(lo), float(close[i]), float(abs(rng.normal(100, 20))), i % 50 + 1))
    return spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, volume double, trades int")


def snapshot(at, k, s, bid, size, ask=101.0, ask_size=1.0):
    return ("BTC", at(k, s), [bid - 0.5 * i for i in range(5)], [size, 1.0, 1.0, 1.0, 1.0], [ask + 0.5 * i for i in range(5)], [ask_size, 1.0, 1.0, 1.0, 1.0])


def test_dwell_weighted_state(spark, at):
    book = spark.createDataFrame([snapshot(at, 0, 0, 100.0, 1.0), snapshot(at, 0, 60, 100.0, 3.0)], BOOK)
    assert math.isclose(O.book_features(book).first()["obi_l1"], 0.4)


def test_order_flow(spark, at):
    book = spark.createDataFrame([snapshot(at, 0, 0, 100.0, 3.0, 101.0, 5.0), snapshot(at, 0, 60, 100.5, 8.0, 101.0, 4.0)], BOOK)
    assert O.book_features(book).first()["ofi"] == 9.0


def test_short_and_empty_books(spark, at):
    book = spark.createDataFrame([("BTC", at(), [100.0], [2.0], [101.0], [1.0]), ("BTC", at(1), [], [], [], [])], BOOK)
    rows = O.book_features(book).orderBy("time").collect()
    assert rows[0]["bid_slope"] == 0.0 and math.isclose(rows[0]["obi_l5"], 1 / 3)
    assert math.isnan(rows[1]["obi_l1"])
    assert O.book_features(book.limit(0)).count() == 0


def test_asof_keeps_nulls_of_the_matched_row(spark, at):
    left = spark.createDataFrame([("A", at(k), k) for k in range(4)], "symbol string, time timestamp, k int")
    right = spark.createDataFrame([("A", at(1), 1.0, 5.0), ("A", at(2), None, 6.0)], "symbol string, time timestamp, x double, y double")
    got = {r.k: (r.x, r.y) for r in asof_join(left, right, ["x", "y"]).collect()}
    assert got == {0: (None, None), 1: (1.0, 5.0), 2: (None, 6.0), 3: (None, 6.0)}


def test_hour_encoding(spark, at):
    row = make_bars(spark, at, 73, ("BTC",)).withColumns(O.day_cycle()).orderBy(F.col("time").desc()).first()
    assert math.isclose(row["hour_sin"], 1) and abs(row["hour_cos"]) < 1e-12


@pytest.fixture(scope="module")
def bulk(spark, at_module):
    bars = make_bars(spark, at_module, 2300)
    return bars, O.compute_features(bars).persist()


@pytest.fixture(scope="module")
def at_module():
    import datetime as dt

    return lambda k=0, s=0: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=5 * k, seconds=s)


def test_tail_of_bulk_equals_buffer(bulk, at_module):
    bars, whole = bulk
    tail = O.compute_features(bars.filter(F.col("time") >= at_module(1100)))
    last = {r.symbol: r for r in whole.filter(F.col("time") == at_module(2299)).collect()}
    seen = 0
    for r in tail.filter(F.col("time") == at_module(2299)).collect():
        for n in FEATURE_NAMES:
            a, b = r[n], last[r.symbol][n]
            assert (a is None) == (b is None), n
            if a is not None:
                seen += 1
                assert math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7), n
    assert seen > 70


def test_chunks_equal_whole(bulk):
    bars, whole = bulk
    cut = O.compute_features(bars, rows=4500).toPandas().sort_values(["symbol", "time"], ignore_index=True)
    all_ = whole.toPandas().sort_values(["symbol", "time"], ignore_index=True)
    assert len(cut) == len(all_)
    for n in FEATURE_NAMES:
        assert np.allclose(cut[n].astype(float), all_[n].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True), n


def test_one_symbol_has_no_cross_features(spark, at):
    df = O.compute_features(make_bars(spark, at, 80, ("BTC",)))
    assert df.columns == ["symbol", "time", *FEATURE_NAMES]
    row = df.agg(F.count("cross_corr_60").alias("x"), F.count("funding_rate").alias("f"), F.count("obi_l1").alias("b"), F.count("ret_1").alias("r"), F.count("roll_spread").alias("s")).first()
    assert tuple(row) == (0, 0, 0, 79, 80)


def test_self_correlation(spark, at):
    bars = make_bars(spark, at, 100, ("BTC",))
    both = bars.unionByName(bars.withColumn("symbol", F.lit("ETH")))
    rows = O.compute_features(both).filter("cross_corr_60 is not null").select("cross_corr_60", "cross_beta_60").collect()
    assert rows and all(math.isclose(v, 1, rel_tol=1e-9) for r in rows for v in r)


def test_all_features_have_the_book_of_the_hour(spark):
    """features_all gives the book columns of features_book on its hourly bars."""
    from tickloom.plans.market import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = {name: {(r.symbol, r.time): r for r in QUERIES[name](spark, sf).select("symbol", "time", *O.BOOK_FEATURES).collect()} for name in ("features_all", "features_book")}
    assert rows["features_all"].keys() == rows["features_book"].keys()
    for key, want in rows["features_book"].items():
        for c in O.BOOK_FEATURES:
            a, b = rows["features_all"][key][c], want[c]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)), (key, c)


def test_numpy_pass_equals_windows(spark):
    """Features of the one numpy pass are those of Spark's row windows, with gaps, flat stretches and zero volumes."""
    from tickloom.functions.series import Series
    from tickloom.plans.market import bars

    df = bars(spark, "/root/testdata/sf0.001")
    k = F.minute("time") + F.hour("time") * 60 + F.dayofmonth("time")
    odd = df.withColumns({"volume": F.when(k % 7 == 0, 0.0).otherwise(F.col("volume")), "close": F.when(F.dayofmonth("time") == 9, F.col("open")).otherwise(F.col("close")), "trades": F.when(k % 5 != 0, F.col("trades"))}).persist()
    s = Series()
    windows = O.bands(O.microstructure(O.volumes(O.volatilities(O.returns(odd, s), s), s), s), s)
    want = O.recursions(windows).join(O.cross_features(windows), ["symbol", "time"], "left").toPandas().sort_values(["symbol", "time"], ignore_index=True)
    for chunk in (50_000, 4100):
        got = O.series_features(odd, chunk).toPandas().sort_values(["symbol", "time"], ignore_index=True)
        assert len(got) == len(want) and (got.time == want.time).all()
        for n in (*O.FROM_BARS, *O.FROM_OTHER):
            a, b = got[n].to_numpy(float), want[n].to_numpy(float)
            assert np.allclose(a, b, rtol=1e-9, atol=1e-12, equal_nan=True), (n, chunk)


@pytest.mark.parametrize("rows", [3, 50, 999, 50_000])
def test_recursions_by_chunks(spark, at_module, rows):
    """One symbol in many chunks, the other in few; extra columns go through."""
    n = 150 if rows == 3 else 2300
    bars = make_bars(spark, at_module, n).filter((F.col("symbol") == "BTC") | (F.col("time") < at_module(40))).withColumn("chunk", F.lit("x"))
    got = O.recursions(bars.drop("chunk"), rows=rows).toPandas().sort_values(["symbol", "time"], ignore_index=True)
    assert len(got) == n + 40 and got.groupby("symbol")["rows"].first().tolist() == [n, 40]
    for _, one in got.groupby("symbol"):
        assert one.idx.tolist() == list(range(len(one)))
        want = R.recursive_arrays(*(one[c].to_numpy() for c in ("high", "low", "close")))
        for k in R.RECURSIVE:
            assert np.allclose(one[k].astype(float), want[k], rtol=1e-9, atol=1e-10, equal_nan=True), k


def test_hot_key_of_the_asof_join_is_spread(spark, at_module):
    """One symbol over many days: the same rows as by whole keys, with matches several buckets back, in many groups."""
    left = spark.range(4000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(1_767_225_600 + F.col("id") * 700).alias("time"), "id")
    right = spark.range(300).filter("id < 40 or id > 200").select(F.lit("A").alias("symbol"), F.timestamp_seconds(1_767_225_600 + F.floor(F.col("id") / 2) * 9000 + 5).alias("time"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"), "id")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = key(asof_join(left, right.withColumnRenamed("id", "seq"), ["x"], tie=("seq",), bucket=None))
    for bucket in (86_400, 3_600):
        cut = asof_join(left, right.withColumnRenamed("id", "seq"), ["x"], tie=("seq",), bucket=bucket)
        assert key(cut) == want
        assert "_bucket" in cut._jdf.queryExecution().executedPlan().toString()
    assert sum(r[-1] is None for r in want) < len(want) and asof_join(left, right.limit(0), ["x"]).filter("x is null").count() == 4000


def plain_book(rows, bar):
    """Book features by loops over the snapshots of one symbol."""
    rows, out = sorted(rows, key=lambda r: r[0]), {}
    div = lambda a, b: math.nan if b == 0 and a == 0 else math.copysign(math.inf, a) if b == 0 else a / b
    for k, (t, bp, bz, ap, az) in enumerate(rows):
        start = t // bar * bar
        end = start + bar
        dwell = min(rows[k + 1][0] if k + 1 < len(rows) else end, end) - t
        z = lambda side, i: side[i] if i < len(side) else 0.0
        b5, a5 = sum(bz[:5]), sum(az[:5])
        near, both = (sum((z(bz, i) + sign * z(az, i)) / (i + 1) for i in range(5)) for sign in (-1, 1))
        state = {"obi_l1": div(z(bz, 0) - z(az, 0), z(bz, 0) + z(az, 0)), "obi_l5": div(b5 - a5, b5 + a5), "depth_ratio_5": div(b5, a5), "obi_weighted": div(near, both), "bid_slope": div(b5, bp[0] - bp[4]) if len(bp) > 4 else 0.0, "spread_bps": (ap[0] - bp[0]) / ((ap[0] + bp[0]) / 2) * 1e4 if bp and ap else 0.0}
        flow = 0.0
        if k:
            _, bp0, bz0, ap0, az0 = rows[k - 1]
            if bp and bp0:
                flow += (z(bz, 0) if bp[0] >= bp0[0] else 0) - (z(bz0, 0) if bp[0] <= bp0[0] else 0)
            if ap and ap0:
                flow -= (z(az, 0) if ap[0] <= ap0[0] else 0) - (z(az0, 0) if ap[0] >= ap0[0] else 0)
        have = out.setdefault(start, {"ofi": 0.0, "_w": 0.0} | dict.fromkeys(state, 0.0))
        have["ofi"] += flow
        have["_w"] += dwell
        for n, v in state.items():
            have[n] += v * dwell
    return {t: {n: v if n == "ofi" else div(v, have["_w"]) for n, v in have.items() if n != "_w"} for t, have in out.items()}


@pytest.mark.parametrize("bar", [300, 3600])
def test_book_by_days_equals_loops(spark, bar):
    """Snapshots over days, with sides that are short or empty; order flow crosses bars and days."""
    rng = np.random.default_rng(5)
    times = np.sort(rng.choice(4 * 86_400, 700, replace=False)) + 1_767_225_600
    side = lambda sign, n: ([float(100 + sign * (1 + i) + rng.integers(0, 3)) for i in range(n)], [float(v) for v in rng.integers(1, 9, n)])
    rows = {s: [(int(t), *side(-1, int(rng.integers(0, 12)) if k % 9 == 0 else 6), *side(1, int(rng.integers(0, 12)) if k % 11 == 0 else 6)) for k, t in enumerate(times)] for s in "AB"}
    book = spark.createDataFrame([(s, *r) for s, some in rows.items() for r in some], "symbol string, s long, bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>").withColumn("time", F.timestamp_seconds("s"))
    for chunk in (50_000, 70):
        got = {(r.symbol, int(r.time.timestamp())): r for r in O.book_features(book, bar, chunk).withColumn("time", F.col("time")).collect()}
        want = {(s, t): v for s, some in rows.items() for t, v in plain_book(some, bar).items()}
        assert {(s, t - t % bar) for s, t in want} == {k for k in want} and len(got) == len(want)
        zone = min(t for _, t in got) - min(t for _, t in want)  # collected times are those of the machine's zone
        for (s, t), v in want.items():
            for n, x in v.items():
                assert math.isclose(got[s, t + zone][n], x, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(x) and math.isnan(got[s, t + zone][n])), (s, t, n)
    series = O.book_features(book, bar).orderBy("symbol", "time").toPandas()
    for _, one in series.groupby("symbol"):
        x = one.spread_bps
        assert np.allclose(one.spread_vol_30.astype(float), x.rolling(30).std(), equal_nan=True, atol=1e-9) and np.allclose(one.spread_z_60.astype(float), (x - x.rolling(60).mean()) / x.rolling(60).std(), equal_nan=True, atol=1e-9)
    plan = O.book_bars(book, bar)._jdf.queryExecution().executedPlan().toString()
    assert "_day" in plan and "Window" not in plan  # groups of a symbol and a day, and no order over a whole symbol
