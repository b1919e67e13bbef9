"""Rolling statistics of one ordered series in numpy, in blocks of rows; NaN until a window is full and where it has a gap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Rows of windows worked on at a time: bounds the temporary arrays.
ROWS = 4096


def rolling(n: int, f: Callable[..., np.ndarray], *series: np.ndarray) -> np.ndarray:
    """f of the last n values of each of the series, which is given matrices of windows."""
    size = len(series[0])
    out = np.full(size, np.nan)
    if size >= n:
        seen = [sliding_window_view(x, n) for x in series]
        for a in range(0, size - n + 1, ROWS):
            part = slice(a, a + ROWS)
            got = f(*(w[part] for w in seen))
            out[n - 1 + a : n - 1 + a + len(got)] = got
    return out


def total(x: np.ndarray, n: int) -> np.ndarray:
    return rolling(n, lambda w: w.sum(1), x)


def mean(x: np.ndarray, n: int) -> np.ndarray:
    return rolling(n, lambda w: w.mean(1), x)


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    return rolling(n, lambda w: w.min(1), x)


def highest(x: np.ndarray, n: int) -> np.ndarray:
    return rolling(n, lambda w: w.max(1), x)


def _centred(w: np.ndarray) -> np.ndarray:
    d = w - w[:, :1]  # so that equal values have a deviation of exactly 0
    return d - d.mean(1, keepdims=True)


def std(x: np.ndarray, n: int, sample: bool = True) -> np.ndarray:
    return rolling(n, lambda w: np.sqrt(np.square(_centred(w)).sum(1) / (n - sample)), x)


def cov(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Population covariance."""
    return rolling(n, lambda a, b: (_centred(a) * _centred(b)).mean(1), x, y)


def var(x: np.ndarray, n: int) -> np.ndarray:
    """Population variance."""
    return rolling(n, lambda w: np.square(_centred(w)).mean(1), x)


def zscore(x: np.ndarray, n: int) -> np.ndarray:
    return (x - mean(x, n)) / std(x, n)


def before(x: np.ndarray, k: int = 1) -> np.ndarray:
    """The value k rows earlier."""
    out = np.full(len(x), np.nan)
    out[k:] = x[: len(x) - k] if k <= len(x) else x[:0]
    return out
