"""Streams that carry state: book bars and bar features equal the batch operators, over restarts and late rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.bar_series import FROM_BARS, FROM_OTHER
from tickloom.operators import features as O
from tickloom.streaming.bars import bar_feature_stream, carried_state
from tickloom.streaming.book import book_stream

BOOK = "symbol string, time timestamp, bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>"
BARS = "symbol string, time timestamp, open double, high double, low double, close double, volume double, trades int"


@pytest.fixture
def rocks(spark):
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set(name, kind)
    yield spark
    spark.conf.unset(name)


def play(spark, stream_of, parts, schema, tmp_path):
    """The rows of a stream whose query is stopped and started again after each part."""
    src, out = tmp_path / "in", tmp_path / "out"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = stream_of(spark.readStream.schema(schema).parquet(str(src)))
        stream.writeStream.format("parquet").outputMode("append").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(out))


def same(got, want, names):
    got, want = ({(r.symbol, r.time): r for r in df.collect()} for df in (got, want))
    assert got and got.keys() <= want.keys()
    for key, r in got.items():
        for n in names:
            a, b = (None if x[n] is None or math.isnan(x[n]) else x[n] for x in (r, want[key]))
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9)), (key, n, a, b)
    return got, want


def test_book_stream_equals_batch(rocks, tmp_path, at):
    spark, rng, rows = rocks, np.random.default_rng(2), []
    for symbol in ("BTC", "ETH"):
        for s in np.sort(rng.choice(70 * 300, 500, replace=False)).tolist():
            n = int(rng.integers(0, 7))
            side = lambda sign: [float(100 + sign * (1 + i) + rng.integers(0, 3)) for i in range(n)]
            rows.append((symbol, at(0, s), side(-1), [float(v) for v in rng.integers(1, 9, n)], side(1), [float(v) for v in rng.integers(1, 9, n)]))
    rows.sort(key=lambda r: r[1])
    cut = [rows[:400], rows[400:430][::-1] + rows[430:700], rows[700:]]
    late = ("BTC", at(0, 7), [1.0], [1.0], [2.0], [1.0])  # of a bar that is closed
    end = [(s, at(80), [99.0], [1.0], [101.0], [1.0]) for s in ("BTC", "ETH")]
    got = play(spark, lambda stream: book_stream(stream, late="10 minutes"), [*cut, [late], end, [(s, at(90), [99.0], [1.0], [101.0], [1.0]) for s in ("BTC", "ETH")]], BOOK, tmp_path)
    want = O.book_features(spark.createDataFrame(rows, BOOK))
    assert got.count() == got.select("symbol", "time").distinct().count()
    found, all_ = same(got.filter(F.col("time") < at(80)), want, O.BOOK_FEATURES)
    assert len(found) == len(all_)


def test_bar_stream_equals_batch(rocks, tmp_path, at):
    spark, rng, rows = rocks, np.random.default_rng(3), []
    for k, symbol in enumerate(("BTC", "ETH")):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 420)))
        for i in range(420):
            if k and i % 17 == 3:
                continue  # gaps on one side
            o = close[i - 1] if i else 100.0
            rows.append((symbol, at(i), float(o), float(max(o, close[i]) * 1.001), float(min(o, close[i]) * 0.999), float(close[i]), float(rng.uniform(50, 150)), int(i % 50 + 1)))
    want = O.compute_features(spark.createDataFrame(rows, BARS)).persist()
    rows.sort(key=lambda r: r[1])
    stored, live = [r for r in rows if r[1] < at(350)], [r for r in rows if r[1] >= at(350)]
    pairs = {"BTC": "ETH", "ETH": "BTC"}
    initial = carried_state(spark.createDataFrame(stored, BARS), pairs)
    parts = [live[:50], live[50:52][::-1] + live[52:], [(s, at(500), 1.0, 1.0, 1.0, 1.0, 1.0, 1) for s in pairs], [stored[0]], [("BTC", at(600), 1.0, 1.0, 1.0, 1.0, 1.0, 1)]]
    got = play(spark, lambda stream: bar_feature_stream(stream, pairs, initial=initial), parts, BARS, tmp_path)
    found, _ = same(got.filter(F.col("time") < at(500)), want, (*FROM_BARS, *FROM_OTHER))
    assert len(found) == len(live) and min(t for _, t in found) == at(350) 
    # from nothing: the first bars are those of a batch, too
    got = play(spark, lambda stream: bar_feature_stream(stream, pairs), [[r for r in rows if r[1] < at(45)], [r for r in rows if at(45) <= r[1] < at(80)], parts[2]], BARS, tmp_path / "second")
    same(got.filter(F.col("time") < at(500)), want, (*FROM_BARS, *FROM_OTHER))
