"""The recursive features of one chunk of a series, from the state in which the chunk before leaves it.

Averages of fixed decay are linear: a chunk maps the state at its start to the state at its end by a matrix and a vector,
which a run from zero gives, and such maps compose by an associative product.  So all chunks find their maps at once, one
scan over the maps gives every chunk its true state, and the features come from runs that begin there: the whole history
counts, as in one pass over the series.  The first value of an exponential average and the plain mean that begins Wilder's
average are maps too, since the place of a row in its series decides them.  Weighted moments have an associative sum of
their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from ..schemas import SIGMA_MIN_PERIODS, SIGMA_SPAN

PERIOD, FAST, SLOW, SIGNAL = 14, 2 / 13, 2 / 27, 2 / 10
DECAY = 1 - 2 / (SIGMA_SPAN + 1)
#: The linear state, in this order: averages of the close, the signal line, and Wilder's averages.
LINEAR = ("fast", "slow", "signal", "up", "down", "atr", "plus", "minus", "range")
CARRIED = ("ret", "sigma_ewma", "rsi_14", "macd_line", "macd_signal", "macd_hist", "atr_14", "adx_14")
_EMAS = (FAST, SLOW, SIGNAL)


def ema_from(x: np.ndarray, alpha: float, state: float) -> np.ndarray:
    """state, alpha * x + (1 - alpha) * state, ... without the first."""
    return pd.Series(np.concatenate([[state], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def rma_from(x: np.ndarray, start: int, state: float, period: int = PERIOD) -> np.ndarray:
    """Wilder's average of values of which the first is the `start`-th of its series; until `period` values are there, a share of their mean."""
    led = state + np.cumsum(x[: max(0, period - start)]) / period
    return np.concatenate([led, ema_from(x[len(led) :], 1 / period, led[-1] if len(led) else state)])


def _rma_decay(n: int, start: int, period: int = PERIOD) -> float:
    """What a state weighs after n values from the `start`-th on."""
    return (1 - 1 / period) ** max(0, n - max(0, period - start))


@dataclass
class Moments:
    """Exponentially weighted mean and squared deviation of n values; the newest weighs 1."""

    n: int = 0
    mean: float = 0.0
    square: float = 0.0

    @staticmethod
    def weight(n) -> float:
        return (1 - DECAY**n) / (1 - DECAY)

    def then(self, later: Moments) -> Moments:
        """Of both, `later` being the newer values."""
        old, new = self.weight(self.n) * DECAY**later.n, self.weight(later.n)
        gap, all_ = later.mean - self.mean, old + new
        return Moments(self.n + later.n, self.mean + gap * new / all_, self.square * DECAY**later.n + later.square + gap * gap * old * new / all_) if all_ else self

    def deviations(self, x: np.ndarray, min_periods: int = SIGMA_MIN_PERIODS) -> np.ndarray:
        """Unbiased standard deviation after each of the values that follow."""
        if not len(x):
            return np.zeros(0)
        mean, square = _zero_start(x)
        k = np.arange(1, len(x) + 1)
        old, new = self.weight(self.n) * DECAY**k, self.weight(k)
        gap, all_, n = mean - self.mean, old + new, self.n + k
        total = square * new + self.square * DECAY**k + gap * gap * old * new / all_
        with np.errstate(all="ignore"):
            variance = total / all_ * all_**2 / (all_**2 - (1 - DECAY ** (2 * n)) / (1 - DECAY**2))
        return np.where((n >= min_periods) & (n > 1), np.sqrt(np.maximum(variance, 0)), np.nan)

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        if not len(x):
            return cls()
        mean, square = _zero_start(x)
        return cls(len(x), float(mean[-1]), float(square[-1] * cls.weight(len(x))))


def _zero_start(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and mean squared deviation of the values up to each."""
    seen = pd.Series(x).ewm(alpha=1 - DECAY, adjust=True)
    return seen.mean().to_numpy(), seen.var(bias=True).to_numpy()


class Chunk:
    """Bars of a chunk in time order; where it doesn't begin its series, the bar before leads."""

    def __init__(self, start: int, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> None:
        if not (np.isfinite(close) & (close > 0)).all():
            raise ValueError("prices must be finite and positive")
        led = start > 0
        self.first, self.start, self.close = not led, start, close[1:] if led else close
        self.step = max(start - 1, 0)  # steps are counted from the second bar of the series on
        move = close[1:] - close[:-1]
        self.ret = np.log(close[1:] / close[:-1])
        reach = np.stack([high[1:] - high[:-1], low[:-1] - low[1:]])
        sides = np.where((reach > reach[::-1]) & (reach > 0), reach, 0.0)
        self.range = np.maximum(high[1:] - low[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
        bars = self.range if led else np.concatenate([high[:1] - low[:1], self.range])
        #: (values, place of the first in their series) of Wilder's averages, by their names in LINEAR.
        self.wilder = {"up": (np.maximum(move, 0), self.step), "down": (np.maximum(-move, 0), self.step), "atr": (bars, self.start), "plus": (sides[0], self.step), "minus": (sides[1], self.step), "range": (self.range, self.step)}

    def run(self, state: np.ndarray) -> dict[str, np.ndarray]:
        """Every linear average after each value, from a state."""
        at = dict(zip(LINEAR, state, strict=True))
        led = self.first and len(self.close)
        fast, slow = (ema_from(self.close, a, self.close[0] if led else at[k]) for a, k in ((FAST, "fast"), (SLOW, "slow")))
        line = fast - slow
        return {"fast": fast, "slow": slow, "signal": ema_from(line, SIGNAL, line[0] if led else at["signal"])} | {k: rma_from(x, n, at[k]) for k, (x, n) in self.wilder.items()}

    def map(self) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, vector) of the linear state over the chunk."""
        zero = np.zeros(len(LINEAR))
        found = self.run(zero)
        b = np.array([found[k][-1] if len(found[k]) else 0.0 for k in LINEAR])
        m, n = np.zeros((len(LINEAR),) * 2), len(self.close)
        if not self.first:  # the first value of a series replaces whatever state there is
            for i, alpha in enumerate(_EMAS):
                m[i, i] = (1 - alpha) ** n
            for i, sign in ((0, 1), (1, -1)):
                m[2, i] = sign * ema_from((1 - _EMAS[i]) ** np.arange(1, n + 1), SIGNAL, 0.0)[-1]
        for k, (x, at) in self.wilder.items():
            i = LINEAR.index(k)
            m[i, i] = _rma_decay(len(x), at)
        return m, b

    def first_range(self) -> int | None:
        """The step at which the range is above 0 for the first time."""
        there = np.flatnonzero(self.range > 0)
        return self.step + int(there[0]) if len(there) else None

    def direction(self, state: np.ndarray, ranged: int | None) -> tuple[np.ndarray, int]:
        """(the directional index of the steps that have one, their place in its series); `ranged` is the first step with a range."""
        mine = self.first_range() if ranged is None else ranged
        if mine is None:
            return np.zeros(0), 0
        begin = max(PERIOD - 1, mine)
        at = dict(zip(LINEAR, state, strict=True))
        plus, minus = (rma_from(*self.wilder[k], at[k]) for k in ("plus", "minus"))
        both = plus + minus
        dx = np.divide(100 * np.abs(plus - minus), both, out=np.zeros_like(both), where=both != 0)
        skip = max(0, begin - self.step)
        return dx[skip:], self.step + skip - begin

    def features(self, state: np.ndarray, moments: Moments, ranged: int | None, index: float) -> dict[str, np.ndarray]:
        """CARRIED of the chunk's bars; `index` is the state of the averaged directional index."""
        found, n = self.run(state), len(self.close)

        def of_steps(values: np.ndarray) -> np.ndarray:
            return np.concatenate([np.full(n - len(values), np.nan), values])

        def seasoned(values: np.ndarray, start: int) -> np.ndarray:
            return np.where(start + np.arange(len(values)) >= PERIOD - 1, values, np.nan)

        up, down = (seasoned(found[k], self.step) for k in ("up", "down"))
        with np.errstate(all="ignore"):
            rsi = np.where(down == 0, np.where(up > 0, 100.0, 50.0), 100 - 100 / (1 + up / down))
        rsi[np.isnan(up)] = np.nan
        dx, at = self.direction(state, ranged)
        line = found["fast"] - found["slow"]
        return {
            "ret": of_steps(self.ret), "sigma_ewma": of_steps(moments.deviations(self.ret)), "rsi_14": of_steps(rsi), "macd_line": line, "macd_signal": found["signal"], "macd_hist": line - found["signal"],
            "atr_14": seasoned(found["atr"], self.start) / self.close, "adx_14": of_steps(seasoned(rma_from(dx, at, index), at)),
        }


def compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The map of two chunks after another."""
    return second[0] @ first[0], second[0] @ first[1] + second[1]


def prefix_maps(matrices: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps of all runs that begin at the first chunk, in a logarithmic number of batched products."""
    m, b, k = matrices.copy(), vectors.copy(), 1
    while k < len(m):
        later_m, later_b = m[k:], b[k:]
        m[k:], b[k:] = later_m @ m[:-k], np.einsum("kij,kj->ki", later_m, b[:-k]) + later_b
        k *= 2
    return m, b
