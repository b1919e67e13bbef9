"""Market messages (JSON text) to table rows; the same expressions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SYMBOLS

#: Numbers come as JSON strings or numbers; read as text, they are cast without failing.
CANDLE = "channel string, data map<string,string>"
LEVEL = "array<struct<px:string,sz:string,n:string>>"
BOOK = f"channel string, data struct<coin:string,time:string,levels:array<{LEVEL}>>"
CONTEXT = "channel string, data struct<coin:string,ctx:struct<funding:string,openInterest:string,markPx:string,oraclePx:string,premium:string>>"
#: Milliseconds of the years 1 to 9999, outside of which a time is none.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def number(text) -> Column:
    return (F.col(text) if isinstance(text, str) else text).try_cast("double")


def _time(ms) -> Column:
    ms = (F.col(ms) if isinstance(ms, str) else ms).try_cast("long")
    return F.when(ms.between(FIRST_MS, LAST_MS), F.timestamp_millis(ms))


def _known(name: str) -> Column:
    return F.col(name).isin(*SYMBOLS)


def _candle(df: DataFrame, data: Column) -> DataFrame:
    """Rows of maps with all prices and the volume present, each a number or null; a count of trades that is none rejects the row.

    The volume-weighted price is never known.  Nothing in a message can make this fail.
    """
    get = lambda k: F.try_element_at(data, F.lit(k))
    read = lambda k: number(get(k))
    good = F.lit(True)
    for k in "ohlcv":
        good = good & F.map_contains_key(data, k) & (get(k).isNull() | read(k).isNotNull())
    trades = F.when(F.abs(read("n")) < 2.0**31, read("n")).cast("int")  # NaN and larger numbers are none
    good = good & (get("n").isNull() | trades.isNotNull())
    out = df.filter(data.isNotNull() & get("s").isin(*SYMBOLS) & good).select(
        get("s").alias("symbol"), _time(get("t")).alias("time"), *[read(k).alias(n) for k, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)], trades.alias("trades"), F.lit(None).cast("double").alias("vwap")
    )
    return out.filter("time is not null")


def candles(messages: DataFrame, value: str = "value") -> DataFrame:
    """ohlcv_bars rows of candle messages; other channels, unknown symbols and broken messages are dropped."""
    return _candle(messages.select(F.from_json(F.col(value), CANDLE).alias("m")).filter("m.channel = 'candle'"), F.col("m.data"))


def history_rows(rows: DataFrame, value: str = "value") -> DataFrame:
    """ohlcv_bars rows of JSON objects as history requests return them."""
    return _candle(rows.select(F.from_json(F.col(value), "map<string,string>").alias("r")), F.col("r"))


def books(messages: DataFrame, value: str = "value") -> DataFrame:
    """orderbook_snapshots rows; both sides must be there and every price and size a number."""
    df = messages.select(F.from_json(F.col(value), BOOK).alias("m")).filter("m.channel = 'l2Book'").select("m.data").filter(_known("data.coin") & (F.size("data.levels") == 2))
    side = lambda i, k: F.transform(F.col("data.levels")[i], lambda x: x[k].try_cast("double"))
    out = df.select(F.col("data.coin").alias("symbol"), _time("data.time").alias("time"), side(0, "px").alias("bid_px"), side(0, "sz").alias("bid_sz"), side(1, "px").alias("ask_px"), side(1, "sz").alias("ask_sz"))
    whole = F.lit(True)
    for c in ("bid_px", "bid_sz", "ask_px", "ask_sz"):
        whole = whole & ~F.exists(c, lambda x: x.isNull())
    return out.filter(F.col("time").isNotNull() & whole)


def contexts(messages: DataFrame, received: Column, value: str = "value") -> DataFrame:
    """funding_oi rows stamped with the receive time; missing values are null."""
    df = messages.select(F.from_json(F.col(value), CONTEXT).alias("m"), received.alias("time")).filter("m.channel = 'activeAssetCtx'")
    names = {"funding": "funding_rate", "openInterest": "open_interest", "markPx": "mark_px", "oraclePx": "oracle_px", "premium": "premium"}
    out = df.select(F.col("m.data.coin").alias("symbol"), "time", F.col("m.data.ctx").alias("ctx")).filter(_known("symbol") & F.col("ctx").isNotNull())
    return out.select("symbol", "time", *[number(f"ctx.{k}").alias(n) for k, n in names.items()])


DECODERS = {"ohlcv_bars": candles, "orderbook_snapshots": books, "funding_oi": contexts}
