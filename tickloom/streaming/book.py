"""Book features of bars while they form: dwell, order flow and spread statistics in state that is carried over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.book_series import BEST, LEVELS, PRICED, STATES, bar_sums, order_flow
from ..schemas import BAR_SECONDS

#: Numbers of a stored snapshot: its time in microseconds, prices (NaN where there is none), sizes by level.
_WIDTH = 1 + 2 * len(PRICED) + 2 * LEVELS
#: Bars whose spreads the statistics look back on.
RING = 60


def _sizes(column: pd.Series) -> np.ndarray:
    out = np.zeros((len(column), LEVELS))
    for k, levels in enumerate(column):
        some = [] if levels is None else levels[:LEVELS]
        out[k, : len(some)] = [0.0 if v is None else v for v in some]
    return np.nan_to_num(out)


def _packed(rows: pd.DataFrame) -> np.ndarray:
    """Snapshots as one matrix of numbers."""
    prices = [rows[f"{s}{i}"].to_numpy(float)[:, None] for s in "ba" for i in PRICED]
    return np.concatenate([rows["at"].to_numpy(np.int64).astype(float)[:, None], *prices, _sizes(rows["bid_sz"]), _sizes(rows["ask_sz"])], axis=1)


class BookBars(StatefulProcessor):
    """By symbol: the snapshots of open bars, the best quotes of the last closed snapshot, and the spreads of the last bars.

    An event-time timer closes a bar once the watermark has passed its end.  Snapshots may come in any order before that; of
    several of one time the first stays; one of a bar that is closed is dropped.
    """

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bar long", "rows binary")
        self.carried = handle.getValueState("carried", "closed long, best binary, spreads binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = self.carried.get()[0] if self.carried.exists() else None
        for part in rows:
            bars = part["at"].to_numpy(np.int64) // 1_000_000 // self.seconds * self.seconds
            packed = _packed(part)
            for bar in np.unique(bars).tolist():
                if closed is not None and bar < closed:
                    continue
                was = self.open.getValue((bar,))[0] if self.open.containsKey((bar,)) else b""
                self.open.updateValue((bar,), (bytes(was) + packed[bars == bar].tobytes(),))
                self.handle.registerTimer((bar + self.seconds) * 1000)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() // 1000
        best, spreads = None, np.zeros(0)
        if self.carried.exists():
            _, raw, past = self.carried.get()
            best = dict(zip(BEST, np.frombuffer(raw), strict=True)) if raw else None
            spreads = np.frombuffer(past) if past else spreads
        due, out = sorted(k[0] for k in self.open.keys() if k[0] + self.seconds <= upto), []
        for bar in due:
            rows = np.frombuffer(self.open.getValue((bar,))[0]).reshape(-1, _WIDTH)
            rows = rows[np.unique(rows[:, 0], return_index=True)[1]]  # in time order, the first of each time
            prices = {f"{s}{i}": (rows[:, 1 + k], np.isnan(rows[:, 1 + k])) for k, (s, i) in enumerate((s, i) for s in "ba" for i in PRICED)}
            sides = rows[:, -2 * LEVELS : -LEVELS], rows[:, -LEVELS:]
            found = bar_sums(rows[:, 0].astype(np.int64), *sides, prices, self.seconds * 1_000_000)
            if best is not None:
                found["ofi"] = found["ofi"] + order_flow({k: found[f"first_{k}"] for k in BEST}, best)
            best = {k: found[f"last_{k}"][0] for k in BEST}
            spreads = np.append(spreads, found["spread_bps"])[-RING:]
            series = pd.Series(spreads)
            stats = {"spread_z_60": ((series - series.rolling(60).mean()) / series.rolling(60).std()).iloc[-1], "spread_vol_30": series.rolling(30).std().iloc[-1]}
            out.append({"symbol": key[0], "time": pd.Timestamp(bar, unit="s", tz="UTC"), **{n: found[n][0] for n in STATES}, "ofi": found["ofi"][0], **stats})
            self.open.removeKey((bar,))
        if due:
            self.carried.update((due[-1] + self.seconds, np.array([best[k] for k in BEST]).tobytes(), spreads.tobytes()))
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def book_stream(stream: DataFrame, seconds: int = BAR_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The rows of `book_features` for a stream of snapshots, each when the watermark passes the end of its bar.

    A snapshot that comes more than `late` behind the latest one may be dropped; a bar without snapshots has no row, as in
    the batch operator, and the last bars wait for later snapshots.
    """
    at = lambda side, i: F.get(f"{side}_px", F.lit(i)).cast("double").alias(f"{side[0]}{i}")
    rows = stream.withWatermark("time", late).select("symbol", "time", F.unix_micros(F.col("time").cast("timestamp")).alias("at"), *[at(s, i) for s in ("bid", "ask") for i in PRICED], "bid_sz", "ask_sz")
    schema = ", ".join(["symbol string", "time timestamp", *(f"{n} double" for n in (*STATES, "ofi", "spread_z_60", "spread_vol_30"))])
    return rows.groupBy("symbol").transformWithStateInPandas(BookBars(seconds), schema, "append", "eventTime")
