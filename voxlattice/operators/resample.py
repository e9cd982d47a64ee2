"""Rational resampling: a polyphase filter bank, a matrix product for each phase of the output."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F

# Taps to each side for a unit of the larger rate, and the window's shape.
REACH, BETA = 10, 5.0


def low_pass(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed sinc that passes what both rates can hold; its sum is `up`."""
    wide = max(up, down)
    place = np.arange(-REACH * wide, REACH * wide + 1)
    taps = np.sinc(place / wide) * np.kaiser(len(place), BETA)
    return taps * (up / taps.sum())


def resample_rational(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """ceil(n up / down) samples at up / down of the rate, without delay; beyond its ends the signal is 0."""
    if up <= 0 or down <= 0:
        raise ValueError("a rate must be positive")
    x = np.asarray(x, np.float64)
    up, down = up // gcd(up, down), down // gcd(up, down)
    if up == down or not len(x):
        return x
    taps, n = low_pass(up, down), -(-len(x) * up // down)
    half, long = len(taps) // 2, -(-len(taps) // up)
    phases = np.zeros((up, long))
    phases.T.flat[: len(taps)] = taps  # tap r + t up stands at [r, t]
    last = (half + (n - 1) * down) // up
    padded = np.concatenate([np.zeros(long - 1), x, np.zeros(max(0, last + 1 - len(x)))])
    windows, out = sliding_window_view(padded, long), np.empty(n)
    for first in range(min(up, n)):  # outputs `up` apart share a phase, and their windows lie `down` apart
        begin, phase = divmod(half + first * down, up)
        count = -(-(n - first) // up)
        out[first::up] = windows[begin::down][:count] @ phases[phase, ::-1]
    return out


def resampled(samples: Column, up: int, down: int) -> Column:
    """array<double> -> array<double>; null stays null."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else resample_rational(x, up, down))

    return run(samples)
