"""Decision tables, sizing, brackets, the risk gate, serving and validation."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import checks, decision, serving
from tickloom.schemas import TABLES


def test_signal_and_action(spark):
    rows = [(0.2, 0.6, 1), (0.6, 0.2, -1), (0.5, 0.5, 1), (0.4, 0.4, 0), (0.5, 0.49, -1)]
    df = spark.createDataFrame(rows, "prob_down double, prob_up double, want int").withColumn("got", decision.signal())
    assert df.filter("got <> want").isEmpty()
    cases = [(0, 1.0, "hold"), (1, 0.0, "enter_long"), (-1, None, "enter_short"), (1, 2.0, "hold"), (1, -2.0, "reverse_long"), (-1, 2.0, "reverse_short")]
    df = spark.createDataFrame(cases, "s int, p double, want string").withColumn("got", decision.action("s", "p"))
    assert df.filter("got <> want").isEmpty()


def test_size_and_brackets(spark):
    row = spark.range(1).select(decision.position_size(F.lit(100.0), F.lit(0.01), F.lit(10_000.0), 1.0, 4, 0.01).alias("s"), decision.position_size(F.lit(0.0), F.lit(0.01), F.lit(1.0)).alias("z"), *[x.alias(n) for n, x in zip("ab", decision.brackets(F.lit(100.0), F.lit("sell"), F.lit(0.01), 1.0, 1.0, 4), strict=True)]).first()
    assert math.isclose(row.s, 100 / (100 * (1 - math.exp(-0.02)))) and row.z == 0
    assert math.isclose(row.a, 100 * math.exp(-0.02)) and math.isclose(row.b, 100 * math.exp(0.02))


BASE = {"symbol": "BTC", "side": "buy", "intent": "entry", "order_type": "limit", "size": 0.1, "price": 60_000.0, "mark": 60_000.0, "position": 0.0, "exposure": 0.0, "equity": 100_000.0, "daily_pnl": 0.0, "open_orders": 0, "kill_switch": False}
TYPES = "symbol string, side string, intent string, order_type string, size double, price double, mark double, position double, exposure double, equity double, daily_pnl double, open_orders int, kill_switch boolean"
EXIT = {"intent": "stop_loss", "order_type": "market", "price": None}


@pytest.mark.parametrize(("change", "ok", "why"), [
    ({}, True, "ok"), ({"kill_switch": True}, False, "kill"), ({"kill_switch": True, **EXIT}, True, "exit"), ({"side": "x"}, False, "side"), ({"size": 0.0}, False, "size"), ({"size": float("nan")}, False, "size"), ({"size": 1e-5}, False, "below"), ({"size": 101.0}, False, "above"),
    ({"order_type": "market"}, False, "fit"), ({"order_type": None}, False, "fit"), ({"price": None}, False, "positive price"), ({"price": 64_000.0}, False, "deviation"), ({"intent": "take_profit", "price": 64_000.0}, False, "deviation"), ({"daily_pnl": -1000.0}, False, "loss"), ({"open_orders": 20}, False, "orders"),
    ({"mark": None}, False, "mark"), ({"equity": 0.0}, False, "equity"), ({"size": 1.0}, False, "position notional"), ({"position": -1.0, "size": 1.5, "exposure": 60_000.0}, True, "ok"), ({"exposure": 95_000.0}, False, "total"), ({"equity": 1000.0}, False, "leverage"), ({**EXIT, "mark": None, "equity": 0.0, "daily_pnl": -5000.0}, True, "exit"),
])
def test_gate(spark, change, ok, why):
    row = decision.gate(spark.createDataFrame([tuple((BASE | change).values())], TYPES)).first()
    assert row.risk_passed == ok and why in row.reason and row.status == ("open" if ok else "rejected")


def test_plan_of_a_reversal(spark):
    df = spark.createDataFrame([("BTC", 0.1, 0.8, 0.01, 100.0, -2.0, 10_000.0), ("ETH", 0.1, 0.8, 0.01, None, 0.0, 1.0)], "symbol string, prob_down double, prob_up double, sigma double, mark double, position double, equity double")
    first, second = decision.plan_orders(df).orderBy("symbol").collect()
    assert [(o.side, o.intent, o.order_type) for o in first.orders] == [("buy", "stop_loss", "market"), ("buy", "entry", "limit"), ("sell", "take_profit", "limit"), ("sell", "stop_loss", "market")]
    assert first.orders[0].size == 2 and first.orders[0].price is None and second.orders == []
    wire = spark.createDataFrame([tuple(o) for o in first.orders], "symbol string, side string, intent string, order_type string, size double, price double").select(decision.wire_order().alias("w")).collect()
    assert wire[0].w is None and json.loads(wire[1].w.order_type) == {"limit": {"tif": "Alo"}} and wire[3].w.reduce_only and "trigger" in json.loads(wire[3].w.order_type)


def test_validation(spark, at):
    df = spark.createDataFrame([(1, "BTC", at(), "buy", "entry", "market", None, None, "open", None, None, None, None, True, None), (2, "BTC", at(), "buy", "stop_loss", "market", None, None, "open", None, None, None, None, True, None)], TABLES["orders"])
    good, bad = checks.validate(df, "orders")
    assert [r.order_id for r in good.collect()] == [2] and bad.first().broken == ["asymmetry"]


def test_snapshot(spark, at):
    make = lambda name, *rows: spark.createDataFrame([tuple(r.get(f) for f in TABLES[name].names) for r in rows], TABLES[name])
    from decimal import Decimal as D

    bars = make("ohlcv_bars", *({"symbol": "BTC", "time": at(k), "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 1.0} for k in range(5)))
    preds = make("model_predictions", {"symbol": "BTC", "time": at(4), "model_version": "v", "prob_down": 0.1, "prob_flat": 0.2, "prob_up": 0.7, "signal": 1, "sigma": 0.01})
    orders = make("orders", {"order_id": 1, "symbol": "BTC", "time": at(0), "intent": "entry", "price": D(10)}, {"order_id": 2, "symbol": "BTC", "time": at(1), "intent": "stop_loss", "price": D(9)})
    feats = make("bar_features", {"symbol": "BTC", "time": at(4), "rsi_14": 55.0})
    pos = make("positions", {"symbol": "BTC", "time": at(4), "size": D(2), "unrealized_pnl": D(7)}, {"symbol": "ETH", "time": at(4), "size": D(-1)})
    out = json.loads(serving.snapshot(preds, bars, orders, feats, pos, F.lit(at(6)), n=3).first().state)
    assert out["metrics"]["openPnl"] == 7 and math.isclose(out["metrics"]["sigma"]["scaled"], 0.01 * math.sqrt(48))
    assert len(out["chart"]["candles"]) == 3 and out["features"] == [{"name": "rsi_14", "value": 55.0}] and out["prediction"]["signal"] == 1
    btc = next(p for p in out["positions"] if p["symbol"] == "BTC")
    assert btc["sl_level"] == 9 and btc["bars_held"] == 6 and btc["side"] == "long"
    empty = json.loads(serving.snapshot(preds.limit(0), bars.limit(0), orders.limit(0), feats.limit(0), pos.limit(0), F.lit(at(6))).first().state)
    assert empty["prediction"] is None and empty["positions"] == [] and empty["metrics"]["openPnl"] == 0


def test_monitoring_of_missing_symbols(spark, at):
    df = spark.createDataFrame([("BTC", at(0)), ("BTC", at(1))], "symbol string, time timestamp")
    rows = {r.symbol: r for r in serving.monitoring(df, F.lit(at(2))).collect()}
    assert (rows["BTC"].rows_total, rows["BTC"].seconds_since_last_write, rows["BTC"].span_seconds) == (2, 300, 300)
    assert rows["ETH"].rows_total == 0 and rows["ETH"].last_write_at is None


def test_throughput(spark, at):
    df = spark.createDataFrame([("A", at(k)) for k in range(10)], "symbol string, time timestamp")
    row = checks.throughput(checks.table_stats(df.limit(4)), checks.table_stats(df), 3.0, 500).first()
    assert tuple(row) == (2.0, 2.0 * 86400, 50.0)


def test_pending_until_sent(spark):
    df = spark.createDataFrame([("buy", "stop_loss", "market", 1.0, None, 10.0, 0.0, 0.0, 0.0, 0.0, 0, False, "BTC")], "side string, intent string, order_type string, size double, price double, mark double, position double, exposure double, equity double, daily_pnl double, open_orders int, kill_switch boolean, symbol string")
    assert [decision.gate(df, sent=sent).first().status for sent in (False, True)] == ["pending", "open"]


def test_latency_is_never_negative(spark, at):
    row = spark.range(1).select(*[serving.latency(F.lit(at(0, s)), F.lit(at(0, 5))).alias(f"s{s}") for s in (3, 8)]).first()
    assert tuple(row) == (0, 3000)


def test_state_provider(spark, tmp_path, at):
    from tickloom.sources.tables import closed_bars, create_tables, write_keyed

    root = str(tmp_path)
    create_tables(spark, root)
    bars = spark.createDataFrame([("BTC", at(k), 1.0, 2.0, 0.5, float(k), 1.0, 1) for k in range(3)], "symbol string, time timestamp, open double, high double, low double, close double, volume double, trades int")
    write_keyed(bars, root, "ohlcv_bars")
    state = serving.StateProvider(spark, root).state(F.lit(at(3)))
    assert [c["close"] for c in state["chart"]["candles"]] == [0.0, 1.0, 2.0] and state["metrics"]["openPnl"] == 0
    assert closed_bars(bars, F.lit(at(2, 299))).count() == 2
