"""Decoding, keyed writes, history requests, streams and supervision."""

import json
import math
import random
import time

from pyspark.sql import functions as F

from tickloom.operators.features import compute_features
from tickloom.sources import decode, history, tables
from tickloom.sources.tables import create_tables, resolve_root, scan, write_keyed
from tickloom.streaming import ingest as S
from tickloom.streaming.subscribe import Journal, available, read_messages, receive, segments
from tickloom.streaming.stateful import cusum_stream, incremental_features

T0 = 1_700_000_000_000


def candle(**change):
    data = {"t": T0, "T": T0 + 299_999, "s": "BTC", "i": "5m", "o": "1.0", "h": 2, "l": "0.5", "c": "1.5", "v": "10", "n": 7} | change
    return json.dumps({"channel": "candle", "data": {k: v for k, v in data.items() if v is not None}})


def book(**change):
    level = lambda px: {"px": px, "sz": "1", "n": 1}
    return json.dumps({"channel": "l2Book", "data": {"coin": "ETH", "time": T0, "levels": [[level("10"), level("9.5")], [level("11"), level("11.5")]]} | change})


def context(**ctx):
    return json.dumps({"channel": "activeAssetCtx", "data": {"coin": "BTC", "ctx": {"funding": "0.0001", "openInterest": "5", "markPx": "6", "oraclePx": "7"} | ctx}})


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_candles(spark):
    good = decode.candles(frame(spark, candle(), candle(s="DOGE"), candle(o="x"), candle(c=None), book(), "not json", candle(n=None))).collect()
    assert [(r.symbol, r.open, r.high, r.trades, r.vwap) for r in good] == [("BTC", 1.0, 2.0, 7, None), ("BTC", 1.0, 2.0, None, None)]


def test_odd_numbers_never_fail(spark):
    odd = [candle(n="x"), candle(n="NaN"), candle(n=1e300), candle(n="7.9"), candle(t=10**30), candle(t=-(10**17)), candle(t="x"), candle(n=[1]), json.dumps({"channel": "candle", "data": None}), json.dumps({"channel": "candle", "data": [1]}), "[]", "", None]
    nulls = json.dumps({"channel": "candle", "data": {"t": T0, "s": "BTC", "o": None, "h": 2, "l": 1, "c": 1, "v": 1, "n": None}})
    assert [(r.open, r.trades) for r in decode.candles(frame(spark, *odd, nulls)).collect()] == [(1.0, 7), (None, None)]
    rows = frame(spark, json.dumps({"t": T0, "s": "ETH", "o": 1, "h": 2, "l": 1, "c": 1, "v": 1, "n": 3}), "{}")
    assert [(r.symbol, r.trades) for r in decode.history_rows(rows).collect()] == [("ETH", 3)]


def test_books_and_contexts(spark):
    rows = decode.books(frame(spark, book(), book(levels=[[]]), book(levels=[[{"px": "x", "sz": "1"}], []]), book(coin="X"), candle())).collect()
    assert [(r.bid_px, r.ask_sz) for r in rows] == [([10.0, 9.5], [1.0, 1.0])]
    (row,) = decode.contexts(frame(spark, context(), candle()), F.lit("2026-01-01").cast("timestamp")).collect()
    assert (row.funding_rate, row.mark_px, row.premium) == (0.0001, 6.0, None)


def test_keyed_writes(spark, tmp_path, at):
    root = str(tmp_path)
    create_tables(spark, root)
    bar = lambda k, c: ("BTC", at(k), 1.0, 2.0, 0.5, c, 1.0, 1)
    make = lambda *rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "symbol string, time timestamp, open double, high double, low double, close double, volume double, trades int, _seq long")
    write_keyed(make(bar(0, 1.0), bar(400, 3.0), bar(0, 2.0)), root, "ohlcv_bars")
    write_keyed(make(bar(0, 9.0)), root, "ohlcv_bars")
    assert {r.time: r.close for r in scan(spark, root, "ohlcv_bars").collect()} == {at(0): 9.0, at(400): 3.0}
    assert scan(spark, root, "ohlcv_bars", ["close"], ["ETH"]).count() == 0 and scan(spark, root, "ohlcv_bars", since=at(1)).count() == 1
    snap = lambda px: spark.createDataFrame([("BTC", at(0), [px], [1.0], [2.0], [1.0], 0)], "symbol string, time timestamp, bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>, _seq long")
    write_keyed(snap(1.0), root, "orderbook_snapshots")
    write_keyed(snap(5.0), root, "orderbook_snapshots")
    assert scan(spark, root, "orderbook_snapshots").first().bid_px == [1.0]


def test_writes_read_only_touched_partitions(spark, tmp_path, at, monkeypatch):
    root = str(tmp_path)
    create_tables(spark, root)
    rows = spark.createDataFrame([(s, at(300 * k), 1.0) for s in ("BTC", "ETH") for k in range(4)], "symbol string, time timestamp, close double")
    write_keyed(rows, root, "ohlcv_bars")
    fresh = rows.filter("symbol = 'BTC'").limit(1).withColumn("date", F.to_date("time"))
    plan = spark.read.parquet(f"{root}/ohlcv_bars").filter(tables.touched_partitions(fresh))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text and len(plan.inputFiles()) >= 1 and plan.count() == 1
    monkeypatch.setattr(tables, "MOST_PARTITIONS", 1)
    write_keyed(rows.withColumn("close", F.lit(2.0)), root, "ohlcv_bars")
    assert [r.close for r in scan(spark, root, "ohlcv_bars").collect()] == [2.0] * 8


def test_stream_equals_batch(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "tables")
    src.mkdir()
    create_tables(spark, root)
    (src / "a.json").write_text("\n".join([candle(), candle(t=T0 + 300_000, c="9"), book(), context()]))
    (src / "b.json").write_text("\n".join([candle(c="7"), candle(s="ETH"), "broken"]))
    stream, counts = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src)), S.Written()
    for _ in range(2):  # a second start finds nothing new
        S.ingest(stream, root, str(tmp_path / "check"), trigger={"availableNow": True}, counts=counts).awaitTermination()
    rows = {(r.symbol, r.time.timestamp() * 1000 - T0): r.close for r in scan(spark, root, "ohlcv_bars").collect()}
    assert set(rows) == {("BTC", 0), ("BTC", 300_000), ("ETH", 0)} and rows["BTC", 300_000] == 9
    assert scan(spark, root, "orderbook_snapshots").count() == scan(spark, root, "funding_oi").count() == 1
    assert counts.written == {"ohlcv_bars": 4, "orderbook_snapshots": 1, "funding_oi": 1} and not counts.dropped


def test_bars_and_first_snapshots_of_streams(spark, tmp_path, at):
    src = tmp_path / "in"
    ticks = [("A", at(0, 1), 5.0, 1.0, 1), ("A", at(0, 9), 3.0, 1.0, 2), ("A", at(0, 299), 4.0, 2.0, 3), ("A", at(1), 9.0, 1.0, 4), ("A", at(1), 8.0, 1.0, 5), ("A", at(9), 1.0, 1.0, 6)]
    schema = "symbol string, time timestamp, price double, size double, seq long"
    for part in (ticks[:4], ticks[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    for name, df in (("bars_out", S.bars_of_ticks(stream)), ("first_out", S.first_snapshots(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert [tuple(r)[1:] for r in spark.table("bars_out").orderBy("time").collect()] == [(at(0), 5.0, 5.0, 3.0, 4.0, 4.0, 3), (at(1), 9.0, 9.0, 8.0, 8.0, 2.0, 2)]
    assert sorted(r.time for r in spark.table("first_out").collect()) == sorted({t[1] for t in ticks})


def test_incremental_features(spark, tmp_path, at):
    """Features kept by micro-batches, one of which corrects a bar, are those of all bars at once."""
    root, src, rng = str(tmp_path / "tables"), tmp_path / "in", random.Random(1)
    create_tables(spark, root)
    schema = "symbol string, time timestamp, open double, high double, low double, close double, volume double, trades int"
    price = lambda: 100 * (1 + 0.1 * rng.random())
    rows = {(s, k): (s, at(k), o := price(), max(o, c := price()) + 1, min(o, c) - 1, c, 10 + rng.random(), k) for s in ("BTC", "ETH") for k in range(80)}
    fixed = {("BTC", 70): ("BTC", at(70), 100.0, 130.0, 90.0, 120.0, 5.0, 1)}
    for part in ({k: v for k, v in rows.items() if k[1] < 75}, fixed | {k: v for k, v in rows.items() if k[1] >= 75}):
        spark.createDataFrame(list(part.values()), schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        incremental_features(stream, root, str(tmp_path / "check"), warm_up=300).awaitTermination()
    want = {(r.symbol, r.time): r for r in compute_features(spark.createDataFrame(list((rows | fixed).values()), schema)).collect()}
    got = {(r.symbol, r.time): r for r in scan(spark, root, "bar_features").collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        for n in ("ret_1", "volume_z_60", "rsi_14", "sigma_ewma", "cross_corr_60"):
            a, b = r[n], want[key][n]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)), (key, n)


def test_cusum_state_is_carried(spark, tmp_path, at):
    src = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame([("A", at(3 * part + k), 0.01, 0.025) for k in range(3)], "symbol string, time timestamp, move double, bar double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("symbol string, time timestamp, move double, bar double").option("maxFilesPerTrigger", 1).parquet(str(src))
    query = cusum_stream(stream).writeStream.format("memory").queryName("fired").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sorted(r.time for r in spark.table("fired").collect()) == [at(2), at(5), at(8)]


def test_history(spark):
    step = 300_000
    calls = []

    def ask(symbol, interval, start, end):
        calls.append(start)
        return history.generated(symbol, interval, start, min(end, start + 10 * step))

    got = [c["t"] for c in history.fetch(ask, "BTC", "5m", 0, 25 * step)]
    assert got == [k * step for k in range(25)] and len(calls) == 3
    assert list(history.fetch(lambda *a: [], "BTC", "5m", 0, step)) == []
    df = history.read_history(spark, ["BTC", "ETH"], "5m", 0, 30 * step, bars=7)
    assert df.count() == 60 and df.columns[-1] == "time"
    assert [(c.start, c.end) for c in history.chunks(["A"], "1m", 0, 150_000, 2)] == [(0, 120_000), (120_000, 150_000)]


def test_supervision():
    assert not S.should_restart(True, 90, 90) and S.should_restart(True, 120, 90) and S.should_restart(False, 0, 90)
    assert [S.backoff(k) for k in (0, 1, 2, 3, 10)] == [1, 1, 2, 4, 60]

    class Query:
        def __init__(self, alive):
            self.isActive, self.runId = alive, len(made)

        def stop(self):
            self.isActive = False

    made, waits, turns = [], [], iter([False, False, False, True])
    start = lambda: made.append(Query(len(made) > 0)) or made[-1]
    assert S.supervise(start, lambda: next(turns), clock=lambda: 0.0, sleep=waits.append) == 1
    assert len(made) == 2 and waits == [15.0, 1.0, 15.0, 15.0] and not made[-1].isActive


def test_root():
    assert resolve_root({"TICKLOOM_ROOT": "/a"}) == "/a" and resolve_root({"TICKLOOM_HOME": "/b"}) == "/b/tables"


def test_a_silent_query_is_started_again(spark, tmp_path):
    """Progress events keep the clock: a query whose source falls silent is restarted, one that takes in rows is not."""
    src, starts, clock = tmp_path / "in", [], [0.0]
    spark.createDataFrame([(1,)], "x int").write.parquet(str(src))
    stream = spark.readStream.schema("x int").parquet(str(src))

    def start():
        starts.append(clock[0])
        query = stream.writeStream.foreachBatch(lambda df, _: df.count()).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start()
        query.processAllAvailable()
        return query

    def sleep(seconds):
        time.sleep(0.5)
        clock[0] += seconds
        if clock[0] in (15.0, 75.0):  # rows come in for a while
            spark.createDataFrame([(int(clock[0]),)], "x int").write.mode("append").parquet(str(src))
            time.sleep(3)

    assert S.supervise(start, lambda: clock[0] >= 300, S.Supervision(), lambda: clock[0], sleep, spark) == len(starts) - 1 >= 1
    assert starts[0] == 0 and 150 < starts[1] <= 200  # 90 idle seconds after the last rows came in, not after the start


MESSAGES = [("candle", "BTC"), ("l2Book", "ETH")]


def test_subscriptions_survive_restarts(spark, tmp_path):
    """A query that is stopped between and within batches takes every message once; batches and tasks are bounded."""
    journal, path, out = Journal(str(tmp_path / "j"), rows=7), str(tmp_path / "j"), tmp_path / "out"
    sizes, kinds = [], "channel string, symbol string, number long, received_ms long, value string"

    def start():
        df = read_messages(spark, path, MESSAGES, rows=10)
        return df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="50 milliseconds").start()

    def connect(first):
        return lambda wanted: ((channel, symbol, f"{channel} {k}\n") for k in range(first, first + 45) for channel, symbol in [*wanted, ("trades", "BTC")])

    for first in (0, 45, 90):
        assert receive(connect(first), MESSAGES, journal) == 90
        query = start()
        time.sleep(0.5 if first == 45 else 2.5)  # the second run is stopped wherever it is
        if first == 90:
            end = time.time() + 60
            while time.time() < end and spark.read.schema(kinds).parquet(str(out)).count() < 270:
                time.sleep(0.5)
        sizes += [p["numInputRows"] for p in query.recentProgress]
        query.stop()
        journal = Journal(path, rows=7)  # a receiver that starts anew goes on with the numbers
    rows = spark.read.schema(kinds).parquet(str(out)).collect()
    assert sorted((r.channel, r.symbol, r.number, r.value) for r in rows) == sorted((c, s, k, f"{c} {k}\n") for c, s in MESSAGES for k in range(135))
    assert max(sizes) <= 20 and sum(n > 0 for n in sizes) > 3


def test_journal_flushes_by_rows_and_time(tmp_path):
    now = [0.0]
    journal = Journal(str(tmp_path), rows=3, seconds=5, clock=lambda: now[0])
    for k in range(4):
        journal.add("candle", "BTC", str(k))
    assert segments(str(tmp_path), "candle", "BTC") == [0] and available(str(tmp_path), "candle", "BTC") == 3
    now[0] = 6.0
    journal.add("candle", "BTC", "4")
    assert segments(str(tmp_path), "candle", "BTC") == [0, 3] and available(str(tmp_path), "candle", "BTC") == 5 and available(str(tmp_path), "candle", "ETH") == 0
