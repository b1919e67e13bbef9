"""All features that one symbol's bars give (with the funding known at each bar and the other symbol's bars), in one numpy pass."""

from __future__ import annotations

import math

import numpy as np

from ..schemas import FEATURE_CATEGORIES, RET_HORIZONS
from . import rolling as R
from .recursive import recursive_arrays

#: The features made here, in the order of the catalogue.
FROM_BARS = tuple(n for c in ("price_return", "volatility", "volume", "technical") for n in FEATURE_CATEGORIES[c]) + ("kyle_lambda", "amihud_illiq", "roll_spread", "vpin_50")
FROM_FUNDING, FROM_OTHER = FEATURE_CATEGORIES["funding_oi"], FEATURE_CATEGORIES["cross_asset"]


def bar_arrays(open_: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, trades: np.ndarray) -> dict[str, np.ndarray]:
    """FROM_BARS of bars in time order; divisions by zero are infinite or NaN, missing values NaN."""
    with np.errstate(all="ignore"):
        log = lambda a, b: np.log(a / b)
        out = {f"ret_{k}": log(close, R.before(close, k)) for k in RET_HORIZONS}
        ret, co = out["ret_1"], log(close, open_)
        low60, high60 = R.lowest(low, 60), R.highest(high, 60)
        out |= {"ret_co": co, "wick_up": log(high, np.maximum(open_, close)), "wick_dn": log(np.minimum(open_, close), low), "price_pos_60": (close - low60) / (high60 - low60), "ret_accel": ret - R.before(ret)}

        span = np.square(log(high, low))
        down = np.where(np.isnan(ret), 0.0, np.square(np.minimum(ret, 0)))  # no move before the first bar
        out |= {
            "realized_vol_30": np.sqrt(R.total(np.square(ret), 30)), "parkinson_30": np.sqrt(R.mean(span, 30) / (4 * math.log(2))),
            "garman_klass_30": np.sqrt(R.mean(0.5 * span - (2 * math.log(2) - 1) * np.square(co), 30)), "downside_vol_30": np.sqrt(R.mean(down, 30)),
        }
        out["vol_of_vol_60"] = R.std(out["realized_vol_30"], 60)

        out |= {"volume_log": np.log1p(volume), "volume_z_60": R.zscore(volume, 60), "volume_ratio_5_30": R.mean(volume, 5) / R.mean(volume, 30), "trade_count_log": np.log1p(trades)}

        value, side = close * volume, np.where(np.isnan(ret), 0.0, np.sign(ret) * volume)
        flow, serial = np.sign(ret) * value, R.cov(ret, R.before(ret), 30)
        out |= {
            "amihud_illiq": np.abs(ret) / value, "kyle_lambda": R.cov(ret, flow, 30) / R.var(flow, 30), "vpin_50": np.abs(R.total(side, 50)) / R.total(volume, 50),
            "roll_spread": 2 * np.sqrt(np.where(serial < 0, -serial, 0.0)),
        }

        centre, spread, bottom, top = R.mean(close, 20), R.std(close, 20, sample=False), R.lowest(low, 14), R.highest(high, 14)
        out["bb_pctb_20"] = np.where(spread == 0, 0.5, (close - centre + 2 * spread) / (4 * spread))
        out["stoch_k_14"] = np.where(top <= bottom, 50.0, (close - bottom) / (top - bottom) * 100)
        return out | recursive_arrays(high, low, close)


def funding_arrays(rate: np.ndarray, interest: np.ndarray) -> dict[str, np.ndarray]:
    """FROM_FUNDING of the funding known at each bar."""
    with np.errstate(all="ignore"):
        return {"funding_rate": rate, "funding_z_60": R.zscore(rate, 60), "oi_log": np.log1p(interest), "oi_change": np.log(interest / R.before(interest))}


def other_arrays(time: np.ndarray, close: np.ndarray, other_time: np.ndarray, other_close: np.ndarray) -> dict[str, np.ndarray]:
    """FROM_OTHER on the bars whose times both symbols have; NaN on the others."""
    out = {n: np.full(len(time), np.nan) for n in FROM_OTHER}
    _, mine, theirs = np.intersect1d(time, other_time, return_indices=True)
    if len(mine):
        with np.errstate(all="ignore"):
            x, y = np.log(close / R.before(close))[mine], np.log(other_close / R.before(other_close))[theirs]
            both, beside = R.cov(x, y, 60), R.var(y, 60)
            out["cross_corr_60"][mine] = both / np.sqrt(R.var(x, 60) * beside)
            out["cross_beta_60"][mine] = both / beside
            out["cross_ret_spread"][mine] = x - y
    return out
