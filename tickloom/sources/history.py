"""History of candles in requests of bounded size, as a Python data source; and a deterministic candle generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import last_by_key

#: Bars of one request, and seconds of a bar by interval (fixed values).
REQUEST_BARS = 4000
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600}


@dataclass
class Chunk(InputPartition):
    symbol: str
    start: int
    end: int

    def __init__(self, symbol: str, start: int, end: int) -> None:
        super().__init__(None)
        self.symbol, self.start, self.end = symbol, start, end


def chunks(symbols: list[str], interval: str, start_ms: int, end_ms: int, bars: int = REQUEST_BARS) -> list[Chunk]:
    """One partition for each symbol and run of at most `bars` candles."""
    step = INTERVALS[interval] * 1000 * bars
    return [Chunk(s, t, min(t + step, end_ms)) for s in symbols for t in range(start_ms, end_ms, step)]


def fetch(ask: Callable[[str, str, int, int], list[dict]], symbol: str, interval: str, start: int, end: int) -> Iterator[dict]:
    """All candles of [start, end): asks on from the last one and stops when nothing new comes."""
    step = INTERVALS[interval] * 1000
    while start < end:
        got = [c for c in ask(symbol, interval, start, min(end, start + REQUEST_BARS * step)) if start <= int(c["t"]) < end]
        if not got:
            return
        yield from got
        start = max(int(c["t"]) for c in got) + step


class CandleHistory(DataSource):
    """format("candle_history"): options symbols, interval, start_ms, end_ms, and `ask`, an importable module:function."""

    @classmethod
    def name(cls) -> str:
        return "candle_history"

    def schema(self) -> str:
        return "symbol string, time_ms long, open double, high double, low double, close double, volume double, trades int, seq long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Chunk]:
        o = self.options
        return chunks(o["symbols"].split(","), o["interval"], int(o["start_ms"]), int(o["end_ms"]), int(o.get("bars", REQUEST_BARS)))

    def read(self, part: Chunk) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options.get("ask", "tickloom.sources.history:generated").partition(":")
        ask = getattr(importlib.import_module(module), name)
        for seq, c in enumerate(fetch(ask, part.symbol, self.options["interval"], part.start, part.end)):
            yield (part.symbol, int(c["t"]), *(float(c[k]) for k in "ohlcv"), int(c["n"]), seq)


def generated(symbol: str, interval: str, start: int, end: int) -> list[dict]:
    """Candles by a linear congruential sequence: the same for the same symbol and time."""
    step, out = INTERVALS[interval] * 1000, []
    first = -(-start // step) * step
    noise = lambda t, k: ((t // step * 1103515245 + k * 12345 + sum(symbol.encode())) % 2147483648) / 2147483648 - 0.5
    for t in range(first, end, step):
        o, c = (100 * (1 + 0.02 * noise(t + d * step, 1)) for d in (0, 1))
        out.append({"t": t, "o": o, "c": c, "h": max(o, c) * (1.001 + 0.001 * abs(noise(t, 2))), "l": min(o, c) * (0.999 - 0.001 * abs(noise(t, 3))), "v": 100 + 40 * noise(t, 4), "n": 1 + t // step % 50})
    return out


def read_history(spark: SparkSession, symbols: list[str], interval: str, start_ms: int, end_ms: int, **options) -> DataFrame:
    """ohlcv_bars rows, one for each symbol and time: the last that came (repeats come in one chunk)."""
    spark.dataSource.register(CandleHistory)
    df = spark.read.format("candle_history").options(symbols=",".join(symbols), interval=interval, start_ms=start_ms, end_ms=end_ms, **options).load()
    rows = df.withColumn("time", F.timestamp_millis("time_ms")).drop("time_ms")
    return last_by_key(rows, ["symbol", "time"], ("seq",)).drop("seq")
