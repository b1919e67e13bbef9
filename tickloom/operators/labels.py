"""Event sampling and labels: symmetric CUSUM, triple barriers, average uniqueness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import scale_to_horizon
from ..functions.series import ROWS_A_CHUNK, running_sum
from ..schemas import H_MULT, HORIZON, PT_MULT, SL_MULT
from ..sources.scratch import kept
from .features import recursions


class Cusum:
    """State of one series: sums of moves up and down since they last fired."""

    def __init__(self) -> None:
        self.up = self.down = 0.0

    def step(self, move: float, bar: float) -> bool:
        """Add a move; true where a sum passes the bar (downward first), which resets that sum alone."""
        if not math.isfinite(move):
            return False
        self.up, self.down = max(0.0, self.up + move), min(0.0, self.down + move)
        if not math.isfinite(bar) or bar <= 0:
            return False
        if self.down < -bar:
            self.down = 0.0
            return True
        if self.up > bar:
            self.up = 0.0
            return True
        return False


#: Rounds in which chunks whose entry state was guessed wrong are run again, before what is left runs series by series.
ROUNDS = 8


def _path(up: float, down: float, moves: list[float], bars: list[float], at: int = 0) -> tuple[list[int], float, float]:
    """(places of the events from `at` on, both sums at the end) of a run from a state."""
    state, on = Cusum(), []
    state.up, state.down = up, down
    for k in range(at, len(moves)):
        if state.step(moves[k], bars[k]):
            on.append(k)
    return on, state.up, state.down


def _corrected(true: tuple[float, float], guess: tuple[float, float], moves: list[float], bars: list[float]) -> tuple[list[int], list[int], int]:
    """Events of the true and of the guessed run up to where both have the same state, and that place (the end, if nowhere)."""
    mine, other, on, off = Cusum(), Cusum(), [], []
    (mine.up, mine.down), (other.up, other.down) = true, guess
    for k in range(len(moves)):
        if mine.up == other.up and mine.down == other.down:
            return on, off, k
        if mine.step(moves[k], bars[k]):
            on.append(k)
        if other.step(moves[k], bars[k]):
            off.append(k)
    return on, off, len(moves)


def cusum_events(df: DataFrame, move: str = "ret", bar: str = "threshold", rows: int = ROWS_A_CHUNK) -> DataFrame:
    """(symbol, idx) of the rows at which the CUSUM filter fires, from (symbol, idx, move, bar).

    Chunks of `rows` rows of a series run at once from a guessed entry, both sums at 0.  The guesses are then replaced by
    the exits of the chunks before: a chunk is run again only to where its true state meets the guessed run (both are the
    same after a reset or a bound at 0 of each sum), and keeps what it found from there on.  Where that changes its exit,
    the next chunk has another round.  Series that are not settled after ROUNDS rounds are run as streams of sorted rows.
    """
    narrow = df.select("symbol", "idx", F.col(move).cast("double").alias("move"), F.col(bar).cast("double").alias("bar"), F.floor(F.col("idx") / rows).cast("long").alias("chunk"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    exits = f"symbol {kinds['symbol']}, chunk long, up double, down double, on array<bigint>"

    def numbers(group: pa.Table) -> tuple[pa.Array, list[float], list[float]]:
        group = group.sort_by("idx")
        move, bar = (group.column(c).to_numpy(zero_copy_only=False).astype(float).tolist() for c in ("move", "bar"))
        return group.column("idx").to_numpy(), move, bar

    def answer(group: pa.Table, up: float, down: float, on: np.ndarray) -> pa.Table:
        return pa.table({"symbol": group.column("symbol").slice(0, 1), "chunk": group.column("chunk").slice(0, 1), "up": [up], "down": [down], "on": pa.array([on.tolist()], pa.list_(pa.int64()))})

    def guess(group: pa.Table) -> pa.Table:
        idx, moves, bars = numbers(group)
        on, up, down = _path(0.0, 0.0, moves, bars)
        return answer(group, up, down, idx[on])

    def again(group: pa.Table, state: pa.Table) -> pa.Table:
        """One chunk from its new entry; `state` has its new and its last entry, and what it found from that."""
        if not group.num_rows or not state.num_rows:
            return pa.table({"symbol": state.column("symbol").slice(0, 0), "chunk": state.column("chunk").slice(0, 0), "up": pa.array([], pa.float64()), "down": pa.array([], pa.float64()), "on": pa.array([], pa.list_(pa.int64()))})
        idx, moves, bars = numbers(group)
        was = state.slice(0, 1).to_pylist()[0]
        true = (was["in_up"], was["in_down"])
        on, _, met = _corrected(true, (was["last_up"], was["last_down"]), moves, bars)
        if met < len(moves):
            return answer(group, was["up"], was["down"], np.concatenate([idx[on], [i for i in was["on"] if i >= idx[met]]]).astype(np.int64))
        on, up, down = _path(*true, moves, bars)
        return answer(group, up, down, idx[on])

    earlier = Window.partitionBy("symbol").orderBy("chunk")
    zero = F.lit(0.0)
    found = kept(narrow.groupBy("symbol", "chunk").applyInArrow(guess, exits).withColumns({"last_up": zero, "last_down": zero}), "cusum")
    for _ in range(ROUNDS):
        entered = found.withColumns({"in_up": F.coalesce(F.lag("up").over(earlier), zero), "in_down": F.coalesce(F.lag("down").over(earlier), zero)})
        wrong = entered.filter((F.col("in_up") != F.col("last_up")) | (F.col("in_down") != F.col("last_down")))
        if wrong.limit(1).count() == 0:
            return found.select("symbol", F.explode(F.col("on").cast(f"array<{kinds['idx']}>")).alias("idx"))
        keys = wrong.select("symbol", "chunk")
        redone = narrow.join(keys, ["symbol", "chunk"], "left_semi").groupBy("symbol", "chunk").cogroup(wrong.groupBy("symbol", "chunk")).applyInArrow(again, exits)
        redone = redone.join(wrong.select("symbol", "chunk", F.col("in_up").alias("last_up"), F.col("in_down").alias("last_down")), ["symbol", "chunk"])
        found = kept(found.join(keys, ["symbol", "chunk"], "left_anti").unionByName(redone), "cusum")
    entered = found.withColumns({"in_up": F.coalesce(F.lag("up").over(earlier), zero), "in_down": F.coalesce(F.lag("down").over(earlier), zero)})
    open_ = entered.filter((F.col("in_up") != F.col("last_up")) | (F.col("in_down") != F.col("last_down"))).select("symbol").distinct()
    settled = found.join(open_, "symbol", "left_anti").select("symbol", F.explode(F.col("on").cast(f"array<{kinds['idx']}>")).alias("idx"))
    return settled.unionByName(_streamed(narrow.join(open_, "symbol", "left_semi"), kinds))


def _streamed(narrow: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """CUSUM events by one pass over each series, sorted within partitions; a task keeps two numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, Cusum()
        for batch in batches:
            on = []
            for name, move, bar in zip(batch["symbol"], batch["move"].astype(float), batch["bar"].astype(float), strict=True):
                if name != symbol:
                    symbol, state = name, Cusum()
                on.append(state.step(move, bar))
            yield batch.loc[on, ["symbol", "idx"]]

    return narrow.repartition("symbol").sortWithinPartitions("symbol", "idx").mapInPandas(run, f"symbol {kinds['symbol']}, idx {kinds['idx']}")


#: Bars of one group in the search for barriers, and events looked at together.
ROWS_A_GROUP, EVENTS = 50_000, 4096


def first_touches(high: np.ndarray, low: np.ndarray, at: np.ndarray, above: np.ndarray, below: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, place) of the first of the `horizon` bars after each place `at` that reaches a level; (0, the last of them) without one.

    A bar that reaches both counts as the lower one.
    """
    label, place = np.zeros(len(at), np.int16), at + horizon
    highs, lows = sliding_window_view(high, horizon), sliding_window_view(low, horizon)
    for k in range(0, len(at), EVENTS):
        some = at[k : k + EVENTS]
        down = lows[some + 1] <= below[k : k + EVENTS, None]
        hit = down | (highs[some + 1] >= above[k : k + EVENTS, None])
        first = hit.argmax(1)
        there = np.flatnonzero(hit.any(1))
        label[k + there] = np.where(down[there, first[there]], -1, 1)
        place[k + there] = some[there] + 1 + first[there]
    return label, place


def triple_barrier(bars: DataFrame, events: DataFrame, pt_mult: float = PT_MULT, sl_mult: float = SL_MULT, horizon: int = HORIZON) -> DataFrame:
    """Label events (symbol, idx) by the first barrier that bars (symbol, idx, time, high, low, close, sigma) touch.

    Events without a whole horizon or with no positive volatility are dropped.  A bar that touches both barriers counts
    as the lower one.  Bars are numbered without gaps; runs of ROWS_A_GROUP of them are groups, each followed by the
    `horizon` bars after it, so a long series is spread over tasks and no event is multiplied.
    """
    size = max(ROWS_A_GROUP, horizon)
    rows = bars.select("symbol", "idx", "time", "high", "low", "close", "sigma").join(events.select("symbol", "idx", F.lit(True).alias("_event")), ["symbol", "idx"], "left")
    run = F.floor(F.col("idx") / size)
    runs = F.when((F.col("idx") % size < horizon) & (run > 0), F.array(run, run - 1)).otherwise(F.array(run))
    rows = rows.withColumn("_run", F.explode(runs)).withColumn("_event", F.coalesce("_event", F.lit(False)) & (F.col("_run") == run))
    kinds, wide = {f.name: f.dataType.simpleString() for f in rows.schema}, math.sqrt(horizon)

    def find(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        high, low, close, sigma = (group.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("high", "low", "close", "sigma"))
        at = np.flatnonzero(group.column("_event").to_numpy(zero_copy_only=False))
        at = at[(at + horizon < len(close)) & np.isfinite(sigma[at]) & (sigma[at] > 0)]
        span = sigma[at] * wide
        above, below = close[at] * np.exp(span * pt_mult), close[at] * np.exp(-span * sl_mult)
        label, touch = first_touches(high, low, at, above, below, horizon) if len(at) else (np.zeros(0, np.int16), at)
        with np.errstate(all="ignore"):
            ret = np.where(label > 0, span * pt_mult, np.where(label < 0, -span * sl_mult, np.log(close[at + horizon] / close[at])))
        take = lambda c, k: group.column(c).take(pa.array(k))
        return pa.table({
            "symbol": take("symbol", at), "idx": take("idx", at), "time": take("time", at), "label": pa.array(label), "ret": pa.array(ret, from_pandas=True), "sigma": pa.array(sigma[at]), "pt_level": pa.array(above), "sl_level": pa.array(below),
            "t1": take("time", at + horizon), "touch_time": take("time", touch), "touch_barrier": pa.array(np.array(["sl", "vertical", "pt"])[label + 1]).cast(pa.string()), "touch_idx": take("idx", touch),
        })

    symbol, idx, time = (kinds[c] for c in ("symbol", "idx", "time"))
    schema = f"symbol {symbol}, idx {idx}, time {time}, label short, ret double, sigma double, pt_level double, sl_level double, t1 {time}, touch_time {time}, touch_barrier string, touch_idx {idx}"
    found = rows.groupBy("symbol", "_run").applyInArrow(find, schema)
    return found.withColumns({"pt_mult": F.lit(float(pt_mult)), "sl_mult": F.lit(float(sl_mult)), "horizon_bars": F.lit(horizon)})


def average_uniqueness(bars: DataFrame, labels: DataFrame, rows: int = ROWS_A_CHUNK) -> DataFrame:
    """`labels` with sample_weight: the mean over [idx, touch_idx] of 1 / (labels open at the bar), at most 1.

    Openings and closings are added up along the bars; two lookups of a prefix sum replace the interval join.  Prefix sums
    are made by chunks of `rows` bars, so a long series is spread over tasks.
    """
    labels = kept(labels, "barriers")
    moves = labels.select("symbol", "idx", F.lit(1).alias("d")).unionByName(labels.select("symbol", (F.col("touch_idx") + 1).alias("idx"), F.lit(-1).alias("d"))).groupBy("symbol", "idx").agg(F.sum("d").alias("d"))
    grid = kept(running_sum(bars.select("symbol", "idx").join(moves, ["symbol", "idx"], "left"), "d", "open", rows=rows), "open-labels")
    grid = running_sum(grid.withColumn("inv", F.when(F.col("open") > 0, 1 / F.greatest("open", F.lit(1)))), "inv", "sum", rows=rows)
    grid = kept(grid.select("symbol", "idx", "inv", "sum"), "uniqueness")
    at = grid.select("symbol", F.col("idx").alias("touch_idx"), F.col("sum").alias("to"))
    begin = grid.select("symbol", "idx", (F.col("sum") - F.coalesce("inv", F.lit(0.0))).alias("from"))
    met = labels.join(at, ["symbol", "touch_idx"]).join(begin, ["symbol", "idx"])
    return met.withColumn("sample_weight", F.least((F.col("to") - F.col("from")) / (F.col("touch_idx") - F.col("idx") + 1), F.lit(1.0))).drop("to", "from")


def labelled_bars(bars: DataFrame, rows: int = ROWS_A_CHUNK) -> DataFrame:
    """Bars numbered within their symbol, with volatility and log return; chunks of `rows` bars carry their state on, as in `recursions`.

    The result is written to the shared folder: events, barriers and weights all read it.
    """
    found = recursions(bars.select("symbol", "time", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")]), rows=rows)
    return kept(found.select("symbol", "time", "high", "low", "close", F.col("sigma_ewma").alias("sigma"), "idx", "ret"), "labelled-bars")


def label_bars(bars: DataFrame, horizon: int = HORIZON, pt_mult: float = PT_MULT, sl_mult: float = SL_MULT, h_mult: float = H_MULT) -> DataFrame:
    """The labels table: CUSUM events at h_mult * sigma * sqrt(horizon), their barriers and weights."""
    df = labelled_bars(bars).withColumn("threshold", scale_to_horizon("sigma", horizon) * h_mult)
    found = average_uniqueness(df, triple_barrier(df, cusum_events(df), pt_mult, sl_mult, horizon))
    return found.select("symbol", "time", "label", "ret", "sigma", "pt_level", "sl_level", "pt_mult", "sl_mult", "horizon_bars", "t1", "touch_time", "touch_barrier", "sample_weight")
