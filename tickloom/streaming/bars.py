"""Features of a stream of bars from carried state: a ring of the last bars for look-backs, and the state of every recursion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import carried as C
from ..functions.bar_series import FROM_BARS, FROM_OTHER, bar_arrays, other_arrays
from ..functions.recursive import RECURSIVE
from ..functions.series import latest
from ..schemas import BAR_SECONDS

#: Bars of the ring: the longest look-back is 240 bars, and statistics of statistics reach 90 bars back.
RING = 300
_NUMBERS = ("open", "high", "low", "close", "volume", "trades")
#: Numbers kept of a bar: its time in seconds and the numbers above; of the other symbol's bar, time and close.
_MINE, _OTHER = 1 + len(_NUMBERS), 2
_CARRY = "closed long, bars long, ring binary, other binary, linear binary, n long, mean double, square double, ranged long, index double"


class Carry:
    """What is known of a series after its closed bars."""

    def __init__(self) -> None:
        self.closed, self.bars = -(1 << 62), 0
        self.ring, self.other = np.zeros((0, _MINE)), np.zeros((0, _OTHER))
        self.linear, self.moments, self.ranged, self.index = np.zeros(len(C.LINEAR)), C.Moments(), None, 0.0

    @classmethod
    def of(cls, row: tuple) -> Carry:
        self = cls()
        self.closed, self.bars, ring, other, linear, n, mean, square, self.ranged, self.index = row
        self.ring, self.other, self.linear = np.frombuffer(ring).reshape(-1, _MINE), np.frombuffer(other).reshape(-1, _OTHER), np.frombuffer(linear)
        self.moments = C.Moments(n, mean, square)
        return self

    def row(self) -> tuple:
        return (self.closed, self.bars, self.ring.tobytes(), self.other.tobytes(), self.linear.tobytes(), self.moments.n, self.moments.mean, self.moments.square, self.ranged, float(self.index))

    def then(self, mine: np.ndarray, other: np.ndarray) -> dict[str, np.ndarray]:
        """Features of new bars in time order (with the other symbol's new bars), which become part of what is known."""
        all_ = np.concatenate([self.ring, mine])
        beside = np.concatenate([self.other, other])
        beside = beside[np.unique(beside[:, 0], return_index=True)[1]]
        found = {k: v[len(self.ring) :] for k, v in (bar_arrays(*all_[:, 1:].T) | other_arrays(all_[:, 0], all_[:, 4], beside[:, 0], beside[:, 1])).items()}
        part = C.Chunk(self.bars, *(np.concatenate([self.ring[-1:, k], mine[:, k]]) for k in (2, 3, 4)))
        exact = part.features(self.linear, self.moments, self.ranged, self.index)
        dx, at = part.direction(self.linear, self.ranged)
        m, b = part.map()
        self.index = float(C.rma_from(dx, at, self.index)[-1]) if len(dx) else self.index
        self.linear, self.moments = m @ self.linear + b, self.moments.then(C.Moments.of(part.ret))
        self.ranged = part.first_range() if self.ranged is None else self.ranged
        self.bars, self.ring, self.other = self.bars + len(mine), all_[-RING:], beside[-2 * RING :]
        return found | {k: exact[k] for k in RECURSIVE}


class BarFeatures(StatefulProcessor):
    """By symbol: bars that wait for the watermark, those of the symbol it is compared with, and a Carry of the closed ones.

    A bar's features are worked out when the watermark passes its end, so both symbols' bars may come in any order before;
    of several bars of one time the last counts; one of a closed time is dropped.
    """

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mine = handle.getMapState("mine", "time long", "numbers binary")
        self.beside = handle.getMapState("beside", "time long", "close double")
        self.carry = handle.getValueState("carry", _CARRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = self.carry.get()[0] if self.carry.exists() else -(1 << 62)
        for part in rows:
            for at, other, *numbers in part[["at", "other", *_NUMBERS]].itertuples(index=False):
                if at <= closed:
                    continue
                if other:
                    self.beside.updateValue((at,), (float(numbers[3]),))
                else:
                    self.mine.updateValue((at,), (np.array(numbers, float).tobytes(),))
                self.handle.registerTimer((at + self.seconds) * 1000)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.seconds
        times = sorted(k[0] for k in self.mine.keys() if k[0] <= upto)
        others = sorted(k[0] for k in self.beside.keys() if k[0] <= upto)
        if not times and not others:
            return
        carry = Carry.of(self.carry.get()) if self.carry.exists() else Carry()
        other = np.array([(t, self.beside.getValue((t,))[0]) for t in others]).reshape(-1, _OTHER)
        if times:
            mine = np.array([(t, *np.frombuffer(self.mine.getValue((t,))[0])) for t in times])
            found = carry.then(mine, other)
            yield pd.DataFrame({"symbol": key[0], "time": pd.to_datetime(times, unit="s", utc=True)} | {n: found[n] for n in (*FROM_BARS, *FROM_OTHER)})
        else:
            carry.other = np.concatenate([carry.other, other])[-2 * RING :]
        for t in times:
            self.mine.removeKey((t,))
        for t in others:
            self.beside.removeKey((t,))
        carry.closed = max(carry.closed, *times, *others)
        self.carry.update(carry.row())

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.carry.update(tuple(initialState.iloc[0][c.split()[0]] if c.split()[0] != "ranged" or pd.notna(initialState.iloc[0]["ranged"]) else None for c in _CARRY.split(", ")))

    def close(self) -> None:
        pass


def _both(bars: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Every bar as its symbol's own, and as the other's of the symbols that are compared with it."""
    beside = F.lit(None).cast("array<string>")
    for other in sorted(set(pairs.values())):
        beside = F.when(F.col("symbol") == other, F.array(*[F.lit(s) for s in sorted(pairs) if pairs[s] == other])).otherwise(beside)
    kinds = F.concat(F.array(F.struct(F.col("symbol").alias("to"), F.lit(False).alias("other"))), F.transform(F.coalesce(beside, F.array().cast("array<string>")), lambda s: F.struct(s.alias("to"), F.lit(True).alias("other"))))
    rows = bars.withColumn("_k", F.explode(kinds))
    return rows.select(F.col("_k.to").alias("symbol"), "time", F.unix_seconds("time").alias("at"), F.col("_k.other").alias("other"), *[F.col(c).cast("double").alias(c) for c in _NUMBERS])


def carried_state(bars: DataFrame, pairs: dict[str, str], n: int = 2 * RING + 2000) -> DataFrame:
    """(symbol, Carry) after stored bars, as the initial state of a stream.  The last n bars are read: older ones weigh below 1e-15."""
    rows = latest(_both(bars, pairs), ("symbol", "other"), n=n)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, carry = group.sort_values("at"), Carry()
        own, beside = group[~group["other"]], group[group["other"]]
        if len(own):
            carry.then(own[["at", *_NUMBERS]].to_numpy(float), beside[["at", "close"]].to_numpy(float))
        carry.closed = int(group["at"].max())
        return pd.DataFrame([(group["symbol"].iloc[0], *carry.row())], columns=["symbol", *(c.split()[0] for c in _CARRY.split(", "))])

    return rows.groupBy("symbol").applyInPandas(run, f"symbol string, {_CARRY}")


def bar_feature_stream(stream: DataFrame, pairs: dict[str, str], seconds: int = BAR_SECONDS, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """(symbol, time, features of bars and against the other symbol) of a stream of bars, each when the watermark passes its end.

    `pairs` names the symbol with which each is compared; `initial` is a `carried_state` of stored bars.  A micro-batch reads
    its own bars and a state of fixed size, so nothing before is read or worked out again.
    """
    rows = _both(stream.withWatermark("time", late), pairs)
    schema = ", ".join(["symbol string", "time timestamp", *(f"{n} double" for n in (*FROM_BARS, *FROM_OTHER))])
    start = None if initial is None else initial.groupBy("symbol")
    return rows.groupBy("symbol").transformWithStateInPandas(BarFeatures(seconds), schema, "append", "eventTime", initialState=start)
