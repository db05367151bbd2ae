"""Per-trace Fourier functions over array<double> columns, Arrow batches at a time.

All traces of a column must be equally long; rows may hold null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _on_batches(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    def run(a: pd.Series) -> pd.Series:
        at = np.flatnonzero(a.notna())
        out: list = [None] * len(a)
        if len(at):
            for k, row in zip(at, f(np.stack(a.iloc[at].to_list()).astype(float)), strict=True):
                out[k] = row
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")


def envelope(a: Column) -> Column:
    """Magnitude of the analytic signal."""

    def f(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        gain = np.zeros(n)
        gain[0] = 1
        gain[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            gain[n // 2] = 1
        return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1))

    return _on_batches(f)(a)


def ramp(f: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Raised cosine from 0 at lo to 1 at hi."""
    return 0.5 - 0.5 * np.cos(np.pi * np.clip((f - lo) / (hi - lo), 0, 1)) if hi > lo else np.ones_like(f)


def band(bins: int, low: float | None, high: float | None, roll: float) -> np.ndarray:
    """Gain over 0..1 (Nyquist): passes from low to high, either may be open."""
    f = np.linspace(0, 1, bins)
    wide = 1.0 if low is None and high is None else high - low if None not in (low, high) else 1 - low if high is None else high
    r = max(roll, 0.05 * max(wide, 1e-4))
    up = ramp(f, max(0.0, low - r), min(1.0, low + r)) if low is not None else np.ones(bins)
    down = 1 - ramp(f, max(0.0, high - r), min(1.0, high + r)) if high is not None else np.ones(bins)
    return up * down


def filtered(a: Column, low: float | None, high: float | None, roll: float = 0.02, standard: bool = False) -> Column:
    def f(x: np.ndarray) -> np.ndarray:
        y = np.fft.irfft(np.fft.rfft(x, axis=1) * band(x.shape[1] // 2 + 1, low, high, roll), n=x.shape[1], axis=1)
        return (y - y.mean(1, keepdims=True)) / (y.std(1, keepdims=True) + 1e-10) if standard else y

    return _on_batches(f)(a)


def magnitude(a: Column) -> Column:
    return _on_batches(lambda x: np.abs(np.fft.rfft(x, axis=1)))(a)
