"""Rational resampling against the direct convolution."""

import numpy as np
import pytest

from voxlattice.operators.resample import low_pass, resample_rational, resampled
from voxlattice.plans.queries_analysis import rational_resample


def direct(x, up, down):
    """Zeros between the samples, the whole filter over them, every `down`th output."""
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    taps = low_pass(up, down)
    return np.convolve(spread, taps)[len(taps) // 2 :][: len(spread)][::down]


@pytest.mark.parametrize("up, down", [(3, 1), (1, 3), (147, 160), (160, 147), (2, 3)])
@pytest.mark.parametrize("n", [1, 2, 50, 1001])
def test_equals_the_direct_convolution(up, down, n):
    x = np.random.default_rng(n).standard_normal(n)
    got = resample_rational(x, up, down)
    assert len(got) == -(-n * up // down)
    assert got == pytest.approx(direct(x, up, down), abs=1e-9)
    assert resample_rational(x, 5 * up, 5 * down) == pytest.approx(got)


def test_tones_and_edges(spark):
    t = np.arange(48_000) / 48_000
    y = resample_rational(np.sin(2 * np.pi * 440 * t), 147, 160)
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(44_100) / 44_100))[500:-500].max() < 1e-3
    assert len(resample_rational(np.zeros(0), 3, 1)) == 0
    with pytest.raises(ValueError):
        resample_rational(np.ones(3), 0, 1)
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [])], "id int, x array<double>").select("id", resampled("x", 3, 1).alias("y")).collect()
    assert [None if r["y"] is None else len(r["y"]) for r in sorted(rows)] == [6, None, 0]


def test_query(spark):
    rows = rational_resample(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["after"] == -(-r["before"] * 147 // 160) for r in rows)
    assert all(abs(r["rms"] - r["rms_after"]) < 0.1 for r in rows if r["before"] > 100)
