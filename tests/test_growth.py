"""What must grow no faster than its input."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.functions.columns import array_pearson, slope
from voxlattice.operators.signal import compare_frame


def test_array_measures_are_linear_in_the_array(spark):
    # 30,000 values a side: 200,000 steps, or billions where a mean is computed again for each value.
    rows = spark.range(1).select(*[F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i, k=k: 2 + F.sin(i * k)).alias(c) for c, k in (("a", 0.7), ("b", 0.4))])
    began = time.perf_counter()
    r = array_pearson(F.col("a"), F.col("b")).alias("r")
    got = rows.select("a", "b", r, slope(F.col("a")).alias("slope"), *[x.alias(n) for n, x in compare_frame(F.col("a"), F.col("b"), F.lit(0.5), F.lit(1.0), F.lit(1.0)).items()]).first()
    assert time.perf_counter() - began < 30
    a, b = np.array(got["a"]), np.array(got["b"])
    assert got["r"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
    assert got["slope"] == pytest.approx(np.polyfit(np.log1p(np.arange(len(a))), np.log(a + 1e-12), 1)[0], abs=1e-9)
    assert got["coloration"] == pytest.approx(np.abs((b - b.mean()) - (a - a.mean())).mean() / 18, abs=1e-9)


def test_pairs_are_dealt_over_all_tasks(spark):
    # Pairs dealt by the key that they are grouped by came in one task, whatever their number.
    from voxlattice.plans.queries_analysis import _sides

    sides = _sides(spark, "/root/testdata/sf0.001")
    assert sides.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_delays_of_envelopes_equal_those_of_a_loop():
    from voxlattice.operators.pair import delay_bins

    rng = np.random.default_rng(1)
    for n, m, lags in ((90, 120, range(-300, 301)), (40, 200, range(55, 80)), (300, 290, range(-20, 21)), (5, 5, range(-3, 4)), (0, 9, range(-3, 4))):
        a, b = rng.random(n), rng.random(m)
        if m == 290:
            b[40:] = a[29:279]
        best, found = -2.0, lags[0]
        for lag in lags:
            x, y = a[max(0, -lag) : max(0, m - lag)], b[max(0, lag) :]
            k = min(len(x), len(y))
            c = x[:k] @ y[:k] / np.sqrt((x[:k] ** 2).sum() * (y[:k] ** 2).sum()) if k >= 8 else -1.0
            best, found = (c, lag) if c > best + 1e-13 else (best, found)
        assert delay_bins(a, b, lags) == (found, pytest.approx(best, abs=1e-12))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_taps_and_knots_are_no_rows(spark):
    from voxlattice.plans import queries_prepare, queries_signal

    data = "/root/testdata/sf0.001"
    assert "Join" not in _plan(queries_signal.sinc_resample(spark, data))  # a join of 32 rows a sample before
    assert _plan(queries_prepare.hinge_basis(spark, data)).count("Generate") == 1  # that of the one row of means; a row's 168 values before


def test_lags_send_no_table_to_the_driver(spark):
    from voxlattice.operators import signal as S

    rows = lambda n, x: spark.range(n).selectExpr("0L as k", "id as i", x)
    a, b = rows(9000, "sin(id * id) as x"), rows(9000, "sin((id - 3) * (id - 3)) + 0.01 as x")
    sums = S.lag_correlation(a, b, ["k"], 5)
    assert "Broadcast" not in _plan(sums) and "Generate explode(sequence(-5" not in _plan(sums)
    got = {r["lag"]: r["c"] for r in sums.collect()}
    x, y = np.sin(np.arange(9000.0) ** 2), np.sin((np.arange(9000.0) - 3) ** 2) + 0.01
    for lag in range(-5, 6):  # over the edges of three stretches
        p, q = x[max(0, -lag) : 9000 - max(0, lag)], y[max(0, lag) : 9000 + min(0, lag)]
        assert got[lag] == pytest.approx(p @ q / np.sqrt((p @ p) * (q @ q)), abs=2e-9)
