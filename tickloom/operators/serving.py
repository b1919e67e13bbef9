"""Read-side queries: latest rows, top-N lists, monitoring and the dashboard snapshot.  `now` is always a parameter."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import scale_to_horizon
from ..functions.series import latest
from ..schemas import BAR_SECONDS, HORIZON, LIVE_FEATURES, PROB_THRESHOLD, SYMBOLS
from ..sources.tables import scan

#: Seconds after which a table counts as stale (fixed values).
STALE_AFTER = {"ohlcv_bars": 420, "orderbook_snapshots": 60, "funding_oi": 180}


def top_latest(df: DataFrame, n: int, symbol: str | None = None, tie: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The n latest rows (of one symbol)."""
    df = df.filter(F.col("symbol") == symbol) if symbol else df
    return df.orderBy(F.col("time").desc(), *tie).limit(n)


def candles(bars: DataFrame, symbol: str, n: int = 200) -> DataFrame:
    """The last n candles of a symbol in time order, with epoch seconds."""
    return top_latest(bars, n, symbol).select(F.unix_seconds("time").alias("time"), "open", "high", "low", "close").orderBy("time")


def latest_price(orders: DataFrame) -> DataFrame:
    """(symbol, intent, price) of the last order with a price."""
    return latest(orders.filter("price is not null"), ("symbol", "intent"), ("time", "order_id")).select("symbol", "intent", "price")


def monitoring(df: DataFrame, now: Column, symbols: tuple[str, ...] | None = SYMBOLS) -> DataFrame:
    """Write statistics by symbol; with `symbols`, one row for each of them and defaults where there is no data."""
    age = lambda a, b: F.round((F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)).cast("long")
    stats = df.groupBy("symbol").agg(F.max("time").alias("last_write_at"), F.min("time").alias("oldest_at"), F.count_if(F.col("time") > now - F.expr("interval 1 hour")).alias("rows_last_1h"), F.count(F.lit(1)).alias("rows_total"))
    stats = stats.withColumns({"seconds_since_last_write": age(now, F.col("last_write_at")), "span_seconds": age(F.col("last_write_at"), F.col("oldest_at"))})
    if symbols is not None:
        stats = df.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string").join(stats, "symbol", "left").na.fill(0, ["rows_last_1h", "rows_total"])
    return stats.select("symbol", "last_write_at", "seconds_since_last_write", "rows_last_1h", "rows_total", "oldest_at", "span_seconds")


def is_stale(seconds: Column, table: str) -> Column:
    return F.when(seconds.isNull() | (seconds > STALE_AFTER[table]), "STALE").otherwise("OK")


def bars_held(entry: Column, now: Column, seconds: int = BAR_SECONDS) -> Column:
    """Whole bars since entry; 0 without an entry or before it."""
    return F.coalesce(F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(entry)) / F.lit(seconds * 1e6)), F.lit(0)), F.lit(0)).cast("int")


def latency(now: Column, stamp: Column) -> Column:
    """Milliseconds since a snapshot's stamp, never below 0."""
    return F.greatest(F.floor((F.unix_micros(now) - F.unix_micros(stamp)) / F.lit(1000)), F.lit(0)).cast("long")


def sigma_view(per_bar: Column, horizon: int = HORIZON) -> Column:
    return F.struct(per_bar.alias("perBar"), F.lit(horizon).alias("horizon"), scale_to_horizon(per_bar, horizon).alias("scaled"))


def position_views(positions: DataFrame, orders: DataFrame, now: Column, horizon: int = HORIZON) -> DataFrame:
    """Latest position of each symbol with its last stop level and the bars held since its last entry; one join for all symbols."""
    stops = latest_price(orders).filter("intent = 'stop_loss'").select("symbol", F.col("price").alias("sl_level"))
    entries = orders.filter("intent = 'entry'").groupBy("symbol").agg(F.max("time").alias("entry_time"))
    met = latest(positions).join(stops, "symbol", "left").join(entries, "symbol", "left")
    held = bars_held(F.col("entry_time"), now)
    side = F.when(F.col("size") > 0, "long").when(F.col("size") < 0, "short").otherwise("flat")
    return met.withColumns({"side": side, "bars_held": held, "horizon": F.lit(horizon), "held_share": F.least(F.greatest(held / F.lit(float(horizon)), F.lit(0.0)), F.lit(1.0))})


def open_pnl(positions: DataFrame) -> DataFrame:
    return positions.agg(F.coalesce(F.sum(F.coalesce("unrealized_pnl", F.lit(0))), F.lit(0)).cast("double").alias("open_pnl"))


def feature_view(features: DataFrame, symbol: str, names: tuple[str, ...] = LIVE_FEATURES) -> DataFrame:
    """(name, value) of the latest row's features that are there."""
    row = top_latest(features, 1, symbol)
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return row.select(F.inline(F.filter(pairs, lambda x: x["value"].isNotNull())))


def snapshot(predictions: DataFrame, bars: DataFrame, orders: DataFrame, features: DataFrame, positions: DataFrame, now: Column, symbol: str = SYMBOLS[0], n: int = 200) -> DataFrame:
    """The dashboard as one row with one JSON column."""
    row = lambda df, name: df.agg(F.first(F.struct("*"), ignorenulls=True).alias(name))
    rows = lambda df, name, order: df.agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))).alias(name))
    levels = latest_price(orders.filter(F.col("symbol") == symbol))
    views = position_views(positions, orders, now)
    money = [F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in views.dtypes]
    parts = [
        row(top_latest(predictions, 1, symbol, ("model_version",)), "prediction"), rows(candles(bars, symbol, n), "candles", "time"), open_pnl(latest(positions)),
        rows(levels.select("intent", F.col("price").cast("double").alias("price")), "barriers", "intent"), rows(feature_view(features, symbol), "features", "name"), rows(views.select(*money), "positions", "symbol"),
    ]
    one = parts[0]
    for part in parts[1:]:
        one = one.join(F.broadcast(part), F.lit(True))  # one row each
    doc = F.struct(
        now.alias("updatedAt"), F.struct(F.lit(None).cast("double").alias("equity"), F.col("open_pnl").alias("openPnl"), F.lit(None).cast("double").alias("winRate"), sigma_view(F.col("prediction.sigma")).alias("sigma")).alias("metrics"),
        F.struct(F.lit(symbol).alias("symbol"), "candles", "barriers").alias("chart"), "prediction", F.lit(PROB_THRESHOLD).alias("probThreshold"), "features", "positions",
    )
    return one.select(F.to_json(doc, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "ignoreNullFields": "false"}).alias("state"))


@dataclass
class StateProvider:
    """The dashboard's state from stored tables: a new snapshot for each call."""

    spark: SparkSession
    root: str
    symbol: str = SYMBOLS[0]

    def state(self, now: Column | None = None) -> dict:
        get = lambda table: scan(self.spark, self.root, table)
        rows = snapshot(get("model_predictions"), get("ohlcv_bars"), get("orders"), get("bar_features"), get("positions"), F.current_timestamp() if now is None else now, self.symbol)
        return json.loads(rows.first()["state"])
