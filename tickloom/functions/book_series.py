"""State features of order book snapshots and what a bar keeps of them, in numpy over Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Levels of a side that any state looks at, and those whose prices are needed (from 0).
LEVELS, PRICED = 10, (0, 4)
STATES = ("obi_l1", "obi_l5", "obi_l10", "bid_depth_5_log", "ask_depth_5_log", "depth_ratio_5", "obi_weighted", "microprice_dev", "bid_slope", "ask_slope", "spread_bps")
#: Best quotes of a snapshot.
BEST = ("b0", "a0", "bs", "as")


def levels(column: pa.ChunkedArray, n: int = LEVELS) -> np.ndarray:
    """(rows, n) sizes of the first n levels; 0 where a side is shorter or a size is missing."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, off = np.append(lists.values.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0), lists.offsets.to_numpy()
    at = off[:-1, None] + np.arange(n)
    there = (at < off[1:, None]) & lists.is_valid().to_numpy(zero_copy_only=False)[:, None]
    return values[np.where(there, at, len(values) - 1)]


def quote(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(prices, which are missing); a price that is not a number is there."""
    return column.to_numpy(zero_copy_only=False).astype(float), column.is_null().to_numpy(zero_copy_only=False)


def states(bid: np.ndarray, ask: np.ndarray, prices: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
    """(values, which are missing) of STATES from sizes by level and prices b0, b4, a0, a4 with their gaps."""
    with np.errstate(all="ignore"):
        depth = lambda side, n: side[:, :n].sum(1)
        b5, a5, b10, a10 = depth(bid, 5), depth(ask, 5), depth(bid, 10), depth(ask, 10)
        (b0, no_b0), (b4, no_b4), (a0, no_a0), (a4, no_a4) = (prices[k] for k in ("b0", "b4", "a0", "a4"))
        near = 1 / np.arange(1, 6)
        mid, unquoted, best = (b0 + a0) / 2, no_b0 | no_a0, bid[:, 0] + ask[:, 0]
        return {
            "obi_l1": ((bid[:, 0] - ask[:, 0]) / best, None), "obi_l5": ((b5 - a5) / (b5 + a5), None), "obi_l10": ((b10 - a10) / (b10 + a10), None),
            "bid_depth_5_log": (np.log1p(b5), None), "ask_depth_5_log": (np.log1p(a5), None), "depth_ratio_5": (b5 / a5, None),
            "obi_weighted": (((bid - ask)[:, :5] @ near) / ((bid + ask)[:, :5] @ near), None), "microprice_dev": (((b0 * ask[:, 0] + a0 * bid[:, 0]) / best - mid) / mid, unquoted),
            "bid_slope": (b5 / (b0 - b4), no_b0 | no_b4), "ask_slope": (a5 / (a4 - a0), no_a0 | no_a4), "spread_bps": ((a0 - b0) / mid * 1e4, unquoted),
        }


def order_flow(now: dict[str, np.ndarray], was: dict[str, np.ndarray]) -> np.ndarray:
    """Change of the best quotes (BEST; a missing price is NaN) from one snapshot to the next: what a side gains at a price no
    worse than before, less what it held at a price no better."""
    bid = np.where(now["b0"] >= was["b0"], now["bs"], 0.0) - np.where(now["b0"] <= was["b0"], was["bs"], 0.0)
    ask = np.where(now["a0"] <= was["a0"], now["as"], 0.0) - np.where(now["a0"] >= was["a0"], was["as"], 0.0)
    return bid - ask


def bar_sums(time: np.ndarray, bid: np.ndarray, ask: np.ndarray, prices: dict[str, tuple[np.ndarray, np.ndarray]], bar: int) -> dict[str, np.ndarray]:
    """What each bar of `bar` microseconds keeps of its snapshots (in time order, epoch microseconds): its start, the states
    weighted by dwell, the order flow within it, and the best quotes of its first and last snapshot.

    A snapshot dwells until the next or the end of its bar.  A missing state counts as 0 in the sum.
    """
    starts = time // bar * bar
    first = np.flatnonzero(np.diff(starts, prepend=starts[:1] - 1))
    last = np.append(first[1:], len(time)) - 1
    following = np.append(time[1:], 0)
    following[last] = starts[last] + bar
    dwell = np.maximum(following - time, 0) / 1e6
    found = states(bid, ask, prices)
    best = {"b0": prices["b0"][0], "a0": prices["a0"][0], "bs": bid[:, 0], "as": ask[:, 0]}
    flow = order_flow(best, {k: np.append(v[:1], v[:-1]) for k, v in best.items()})
    flow[first] = 0.0
    out = {"time": starts[first], "ofi": np.add.reduceat(flow, first)}
    with np.errstate(all="ignore"):
        whole = np.add.reduceat(dwell, first)
        for name, (value, missing) in found.items():
            out[name] = np.add.reduceat(np.where(missing, 0.0, value * dwell) if missing is not None else value * dwell, first) / whole
    return out | {f"first_{k}": v[first] for k, v in best.items()} | {f"last_{k}": v[last] for k, v in best.items()}
