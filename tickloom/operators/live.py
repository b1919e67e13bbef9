"""The live path: recent rows by pruned scans, closed bars, scores of the last windows, plans, the risk gate and written orders."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import latest
from ..schemas import BAR_SECONDS, FEATURE_NAMES, SEQ_LEN, WARMUP_BARS
from ..sources.scratch import kept
from ..sources.tables import closed_bars, number_orders, scan, write_keyed
from .decision import gate, plan_orders, risk_state
from .features import compute_features
from .model import infer_latest

_FOLDER = re.compile(r"/symbol=([^/]+)/date=([^/]+)/")


def stored_days(table: DataFrame) -> dict[str, list[str]]:
    """The days of each symbol that have files, newest first; read from the names that Spark has listed, no file is opened."""
    days: dict[str, set[str]] = {}
    for file in table.inputFiles():
        m = _FOLDER.search(file)
        if m and m[2] != "__HIVE_DEFAULT_PARTITION__":
            days.setdefault(m[1], set()).add(m[2])
    return {s: sorted(d, reverse=True) for s, d in days.items()}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def recent_tables(spark: SparkSession, root: str, n: int = WARMUP_BARS + SEQ_LEN, symbols: tuple[str, ...] | None = None, now: Column | None = None, seconds: int = BAR_SECONDS, others: tuple[str, ...] = ("orderbook_snapshots", "funding_oi")) -> dict[str, DataFrame]:
    """ohlcv_bars with the last n bars of each symbol (those closed by `now`), and the other tables from the first of them on.

    Days are walked from the newest back, twice as many each time, until each symbol has n bars or no more days; every
    scan has literal bounds on symbol and date, so it lists and reads only those partitions.
    """
    bars = scan(spark, root, "ohlcv_bars", ["symbol", "time", "date", "open", "high", "low", "close", "volume", "trades"], symbols)
    bars = closed_bars(bars, now, seconds) if now is not None else bars
    days = {s: d for s, d in stored_days(scan(spark, root, "ohlcv_bars", symbols=symbols)).items() if not symbols or s in symbols}
    deep, enough = dict.fromkeys(days, max(1, -(-n * seconds // 86_400))), {}
    within = lambda s: (F.col("symbol") == s) & (F.col("date") >= F.lit(days[s][min(deep[s], len(days[s])) - 1]).cast("date"))
    while open_ := [s for s in days if s not in enough]:
        found = {r["symbol"]: r["count"] for r in bars.filter(_any([within(s) for s in open_])).groupBy("symbol").count().collect()}  # a row a symbol
        for s in open_:
            if found.get(s, 0) >= n or deep[s] >= len(days[s]):
                enough[s] = True
            else:
                deep[s] *= 2
    tail = latest(bars.filter(_any([within(s) for s in days])), n=n)
    first = {r["symbol"]: (r["t"], r["d"]) for r in tail.groupBy("symbol").agg(F.min("time").alias("t"), F.min("date").alias("d")).collect()}  # a row a symbol
    since = _any([(F.col("symbol") == s) & (F.col("date") >= F.lit(d)) & (F.col("time") >= F.lit(t)) for s, (t, d) in sorted(first.items())])
    out = {"ohlcv_bars": bars.filter(since).drop("date")}
    for name in others:
        out[name] = scan(spark, root, name, symbols=symbols, where=since)
    return out


def live_step(spark: SparkSession, root: str, now: Column, logits: Callable[[np.ndarray], np.ndarray], version: str, accounts: DataFrame, seq_len: int = SEQ_LEN, warm_up: int = WARMUP_BARS, names: tuple[str, ...] = FEATURE_NAMES, symbols: tuple[str, ...] | None = None, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, orders) of the latest closed bar of each symbol; both are written to their tables.

    Scores come from the last `seq_len` bars by `logits`; plans from the scores, the last closes, the stored positions and
    the one row of `accounts` (equity, daily_pnl, open_orders, kill_switch); orders pass the risk gate and are recorded as
    pending or rejected, numbered on from the last stored one.  Symbols with a short or unfinished window have neither.
    """
    recent = recent_tables(spark, root, warm_up + seq_len, symbols, now)
    found = compute_features(recent["ohlcv_bars"], recent["orderbook_snapshots"], recent["funding_oi"])
    scored = kept(infer_latest(found, logits, version, seq_len, names), "predictions")
    write_keyed(scored, root, "model_predictions")
    account = accounts.select("equity", "daily_pnl", "open_orders", "kill_switch").withColumn("account", F.lit(0)).limit(1)
    marks = latest(recent["ohlcv_bars"]).select("symbol", F.col("close").alias("mark"))
    held = latest(scan(spark, root, "positions")).select(F.lit(0).alias("account"), "symbol", F.col("size").cast("double").alias("position"))
    # One row a symbol, and one of the account: small by themselves, so the joins are left to the optimiser.
    plans = scored.join(marks, "symbol").join(held.drop("account"), "symbol", "left").withColumn("account", F.lit(0)).join(account.select("account", "equity"), "account")
    orders = plan_orders(plans.na.fill(0.0, ["position"])).select("time", "account", F.explode("orders").alias("o")).select("time", "account", "o.*")
    stated = gate(risk_state(orders, held, marks, account), limits, sent=False)
    last = scan(spark, root, "orders", ["order_id"]).agg(F.max("order_id").alias("m")).first()["m"]
    numbered = kept(number_orders(stated, last or 0), "orders")
    write_keyed(numbered, root, "orders")
    return scored, numbered
